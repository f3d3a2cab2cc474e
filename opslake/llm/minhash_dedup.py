"""Near duplicates by MinHash bands, odd sketches and a check on full shingle sets."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opslake.llm.components import component_labels
from opslake.llm.rows import shielded, text_of, text_slices, without
from opslake.session import fresh_path

#: Words of a shingle.
SHINGLE = 5
#: Bands and rows of the signature: a pair at similarity 0.85 meets in no band with probability 8e-7.
BANDS, ROWS = 24, 5
#: Bits of an odd sketch.
SKETCH = 512
#: Standard deviations by which a pair's sketches may look too far apart and the pair still be checked.
SLACK = 5.0
#: Rows of one side of a block of pairs in one bucket.
BLOCK = 256
#: Bits (as a power of two) of the filter that spares shingling the texts of documents without candidates again.
FILTER_BITS = 24

_MULTIPLIERS = np.random.default_rng(20).integers(1 << 62, size=(SHINGLE + BANDS * ROWS + 2,), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, remembered: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.remembered = remembered

    def __call__(self, text: bytes) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        ids = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = xxh3_64_intdigest(w)
                if len(w) <= 64:
                    known[w] = h
            ids[i] = h
        n = min(SHINGLE, len(words))
        ids = _mix(ids)
        sums = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
        for k in range(n):
            sums += ids[k:k + len(sums)] * _MULTIPLIERS[k]
        return np.unique(_mix(sums))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least hash under each of BANDS * ROWS hash functions; long sets are taken in pieces."""
    m = _MULTIPLIERS[SHINGLE:SHINGLE + BANDS * ROWS, None]
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        out = np.minimum(out, (shingles[None, i:i + 2048] * m + (m >> np.uint64(7))).min(axis=1))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for different bands."""
    parts = _mix(sig).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
    for r in range(ROWS):
        keys = _mix(keys * _MULTIPLIERS[-1] + parts[:, r])
    return keys.view(np.int64)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples (position, least hash) as SKETCH / 64 longs."""
    at = _mix(sig + np.arange(len(sig), dtype=np.uint64) * _GOLD) % np.uint64(SKETCH)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def sketch_limit(similarity: float) -> int:
    """Most differing bits of two sketches for which the pair is still a candidate.

    Of k samples k (1 - J) differ on average, each flips two of n bits; expected differing bits are
    n / 2 (1 - (1 - 2 / n)^(2 k (1 - J))). ``SLACK`` standard deviations of the samples are added first.
    """
    k = BANDS * ROWS
    apart = k * (1 - similarity) + SLACK * (k * similarity * (1 - similarity)) ** 0.5
    u = SKETCH / 2 * (1 - (1 - 2 / SKETCH) ** (2 * apart))
    return int(np.ceil(u + SLACK * (SKETCH / 4 * (1 - 2 * u / SKETCH)) ** 0.5 / 2))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) to id, key, n_shingles, digest of the set, bands and sketch."""
    from xxhash import xxh3_128_digest

    shingle = Shingler()
    for part, texts in text_slices(batches, "_text"):
        ns, digests, keys, sketches = [], [], [], []
        for t in texts.to_pylist():
            s = shingle(t)
            ns.append(len(s))
            if len(s):
                sig = signature(s)
                digests.append(xxh3_128_digest(s.tobytes()))
                keys.append(bands(sig))
                sketches.append(odd_sketch(sig))
            else:
                digests.append(None)
                keys.append(None)
                sketches.append(None)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
            names=["_id", "_key", "n_shingles", "_digest", "_bands", "_sketch"])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filter_words(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2^FILTER_BITS bits with a bit for each key; its size does not depend on the number of keys."""
    bit = F.pmod(F.col(column), F.lit(1 << FILTER_BITS))
    rows = keys.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")).alias("word")).collect()
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in rows:
        words[r["at"]] = r["word"]
    return words.view(np.uint64)


def _shingles_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes (node, _key), from the texts (_id, _key, _text).

    Only texts whose key passes a fixed-size bitmap are shingled again; the join then leaves the nodes themselves.
    """
    words = docs.sparkSession.sparkContext.broadcast(_filter_words(nodes, "_key"))

    def run(batches):
        shingle, bits = Shingler(), words.value
        for part, texts in text_slices(batches, "_text"):
            keys = part.column(0).to_numpy().astype(np.int64)
            at = (keys % (1 << FILTER_BITS)).astype(np.uint64)
            hit = np.flatnonzero(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
            if len(hit):
                sets = [shingle(texts[int(i)].as_py()).view(np.int64) for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(sets, pa.list_(pa.int64()))], names=["_key", "shingles"])

    found = docs.select("_key", "_text").mapInArrow(run, "_key bigint, shingles array<bigint>")
    return found.join(nodes.select("node", "_key"), "_key").dropDuplicates(["node"]).select("node", "shingles")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) those with den * intersection >= num * union of their full shingle sets."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    near = den * both >= num * (F.size("_sa") + F.size("_sb") - both)
    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b")


def near_groups(docs: DataFrame, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Class of near duplicates of every row: _id, n_shingles, component (smallest id of the class) and two keys.

    ``_key`` is a hash of the row's id and text, ``_first`` that of the row which stands for the class.

    A document's set holds its distinct 5-word shingles, A-Z lower-cased, words being split at ASCII white space; with
    fewer words the whole sequence is one shingle, without words the set is empty and links with nothing. Documents link
    if den * intersection >= num * union. Rows are told apart by id and text: rows with a null id have their own class
    with others of the same set, whose component is null only if no member has an id; an empty set's component is the
    row's own id. No rows give no rows.

    1. One pass writes set size, digest, band keys and odd sketch of each row. Rows with equal sets form one node.
    2. Nodes that share a band key with another get their full sets. A node can only have a partner if at least the
       share num / den of its shingles occurs in another such node; counting shingles leaves out the rest, exactly.
    3. In each bucket every node is checked against the bucket's most central node. Most of a large group of near copies
       is linked so, one check per node and bucket.
    4. Nodes that, given the bucket's least size and the number of their shingles which others have, can have no partner
       leave the bucket. Pairs of one bucket that are not yet in one component are compared by these numbers and by
       their sketches, in blocks and in the first band they share, and those that remain by their full sets. No link between components is lost but for the bands' own chance.
    """
    table = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(doc_id), text_of(text)).alias("_key"), text_of(text).alias("_text"))
    rows = _written(table.mapInArrow(_describe, "_id bigint, _key bigint, n_shingles bigint, _digest binary, _bands array<bigint>, _sketch array<bigint>"), "described")
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id"), F.col("_key"), F.col("_bands"), F.col("_sketch"), F.col("n_shingles"))).alias("f")
    nodes = rows.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(first).select(
        "_digest", F.col("f._id").alias("_id"), F.col("f._key").alias("_key"), F.col("f._bands").alias("_bands"), F.col("f._sketch").alias("_sketch"),
        F.col("f.n_shingles").alias("n")).withColumn("node", F.monotonically_increasing_id())
    nodes = _written(nodes, "nodes")

    spread = nodes.select("node", F.explode("_bands").alias("band"))
    shared = spread.groupBy("band").count().where(F.col("count") > 1).select("band")
    met = _written(spread.join(shared, "band"), "met")
    some = _written(met.select("node").distinct().join(nodes.select("node", "_key", "n"), "node"), "some")
    sets = _written(_shingles_of(table, some), "sets")
    each = sets.select("node", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("one")).where(F.col("c") > 1).select("s", "c")
    weight = each.join(common, "s").groupBy("node").agg(F.count("*").alias("held"), F.sum(F.log2("c")).alias("central"))
    able = _written(weight.join(some, "node").where(den * F.col("held") >= num * F.col("n")).select("node", "central", "n", "held"), "able")

    met = _written(met.join(able, "node").select("band", "node", "central", "n", "held"), "met")
    heads = _written(met.groupBy("band").agg(F.max(F.struct("central", F.col("node"))).alias("h"), F.count("*").alias("m")).where(
        F.col("m") > 1).select("band", F.col("h.node").alias("head"), "m"), "heads")
    pairs = met.join(heads, "band").where(F.col("node") != F.col("head")).select(
        F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    links = _written(_linked(pairs, sets, num, den), "links")
    label = component_labels(links)

    placed = met.join(label, "node", "left").select("band", "node", "n", "held", F.coalesce("label", "node").alias("label"))
    placed = _written(placed, "placed")
    # A partner in the bucket has at least its least size, and shares at most the shingles that others have at all.
    least = placed.groupBy("band").agg(F.min("n").alias("least"))
    placed = placed.join(least, "band").where(den * F.col("held") >= num * (F.col("n") + F.col("least") - F.col("held")))
    placed = _written(placed.drop("least"), "placed")
    open_ = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where(
        F.col("lo") != F.col("hi")).select("band", "m")
    left = placed.join(open_, "band").join(nodes.select("node", "_sketch", "_bands"), "node").withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK)).cast("int"))
    left = _written(left, "open")
    one = left.select("band", "node", "n", "held", "label", "_sketch", "_bands", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    two = left.select("band", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("held").alias("held2"),
                      F.col("label").alias("label2"), F.col("_sketch").alias("_sketch2"), F.col("_bands").alias("_bands2"),
                      F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    apart = F.aggregate(F.zip_with("_sketch", "_sketch2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.least("held", "held2")
    able_pair = den * both >= num * (F.col("n") + F.col("n2") - both)
    more = one.join(two, ["band", "block"]).where((F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2")) & able_pair & (
        apart <= sketch_limit(num / den)) & (F.try_element_at(F.array_intersect("_bands", "_bands2"), F.lit(1)) == F.col("band"))).select(
        F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    links = links.union(_written(_linked(_written(more, "more"), sets, num, den), "links"))
    label = component_labels(links)

    named = nodes.select("node", "_digest", "_id", "_key").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = _written(named, "named")
    least = named.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id"), F.col("_key"))).alias("f"))
    of_digest = _written(named.join(least, "label").select("_digest", F.col("f._id").alias("component"), F.col("f._key").alias("_first")), "classes")
    empty = F.col("_digest").isNull()
    return rows.join(of_digest, "_digest", "left").select(
        "_id", "_key", "n_shingles", F.when(empty, F.col("_id")).otherwise(F.col("component")).alias("component"),
        F.when(empty, F.col("_key")).otherwise(F.col("_first")).alias("_first"))


@shielded
def keep_one(docs: DataFrame, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class one row with its smallest id stays.

    Rows without an id stay only if their class has no id. Of rows repeated under one id and text one stays; texts without
    words are no duplicates of each other and all stay but such repeats. Columns are those of ``docs``.
    """
    found = _written(near_groups(docs, num, den, doc_id, text), "found")
    out = found.where(F.col("_key") != F.col("_first")).select("_key").distinct()
    again = found.where(F.col("_key") == F.col("_first")).groupBy("_key").count().where(F.col("count") > 1).select("_key")
    rows = docs.withColumn("_key", F.xxhash64(F.col(doc_id), text_of(text)))
    again = _written(again, "again")
    once = without(rows.join(out.union(again), "_key", "left_anti"), "_key")
    if not again.limit(1).count():
        return once
    return once.unionByName(without(rows.join(again, "_key", "left_semi").dropDuplicates(["_key"]), "_key"))
