"""Remove every byte of a long string that occurs twice, by sorting a covering sample of suffixes and merging the rest."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from opslake.llm.rows import text_of, text_slices
from opslake.session import fresh_path

#: Bytes of the n-gram that a position is judged by, and start positions among which one is sampled.
GRAM, COVER = 8, 96
#: Different neighbourhoods with the same sampled prefix that one task compares in memory; more are compared by an exchange.
GROUP_ROWS = 2048
#: A key with more than this share of the rows is joined by broadcast: there can be at most 1 / share.
HOT_SHARE = 0.001
#: Start positions handled at once, which must leave room for a position in the low bits of a sort key.
CHUNK, POSITION_BITS = 1 << 21, 24
ADDED = ("n_bytes", "n_removed", "n_spans", "removed", "kept")


def _grams(b: np.ndarray) -> np.ndarray:
    """Mixed 64-bit value of the 8 bytes from each position on; zeros stand behind the end."""
    b = np.concatenate((b, np.zeros(GRAM, np.uint8))).astype(np.uint64)
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        b = b[:-step] | (b[step:] << np.uint64(shift))
    b = (b[:len(b) - 1] ^ (b[:len(b) - 1] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (b ^ (b >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def sampled(b: np.ndarray, ends: np.ndarray, length: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sample: (text, position, first, last) where ``position`` represents the strings that start at first .. last.

    The string of ``length`` bytes at p is represented by that of its first COVER positions whose 8 bytes hash lowest (the
    last of equals), so equal strings are represented at the same distance from their start, wherever they stand.
    Texts lie one after the other in b and end at ``ends``.
    """
    texts, at, first, last = [], [], [], []
    mask = np.uint64((1 << POSITION_BITS) - 1)
    total = len(b)
    for c in range(0, max(0, total - length + 1), chunk):
        stop = min(total - length + 1, c + chunk)
        part = b[c:min(total, stop + COVER + GRAM)]
        key = (_grams(part)[:len(part)] & ~mask) | (mask - np.arange(len(part), dtype=np.uint64))
        width = 1
        while width * 2 <= COVER:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[:len(key) - (COVER - width)], key[COVER - width:])[:stop - c]
        position = (mask - (key & mask)).astype(np.int64) + c
        p = np.arange(c, stop)
        text = np.searchsorted(ends, p, side="right")
        ok = (text < len(ends)) & (p + length <= ends[np.minimum(text, len(ends) - 1)])
        p, text, position = p[ok], text[ok], position[ok]
        if len(p):
            new = np.flatnonzero(np.concatenate(([True], (position[1:] != position[:-1]) | (text[1:] != text[:-1]))))
            texts.append(text[new])
            at.append(position[new])
            first.append(p[new])
            last.append(p[np.append(new[1:], len(p)) - 1])
    joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (texts, at, first, last)]
    return tuple(joined)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _sample_rows(length: int):
    """Arrow rows (name, owner, at): the hash of the prefix that a sampled suffix shares with all strings it represents."""
    short = length - COVER + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for part, texts in text_slices(batches, "text"):
            values = texts.to_pylist()
            whole = b"".join(values)
            ends = np.cumsum([len(v) for v in values])
            text, at, first, last = sampled(np.frombuffer(whole, np.uint8), ends, length)
            view = memoryview(whole)
            name = np.fromiter((xxh3_64_intdigest(view[a:a + short]) for a in at.tolist()), np.uint64, len(at)).view(np.int64)
            owner = np.asarray(part.column(0))[text]
            start = (ends - [len(v) for v in values])[text]
            packed = (at - start) << 14 | (at - first) << 7 | (at - last)
            for i in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i:i + (1 << 16)], pa.int64()) for x in (name, owner, packed)], ["name", "owner", "at"])

    return run


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name, those whose name a neighbour shares; the first and last name of a task always pass, as they may go on next door."""
    held, begun = None, False
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        name = np.asarray(table.column("name").combine_chunks())
        same = name[1:] == name[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if not begun:
            keep |= name == name[0]
            begun = True
        elif held is not None:
            keep[0] |= held_keep
        held, held_keep = table.slice(table.num_rows - 1).to_batches()[0], bool(keep[-1])
        out = table.slice(0, table.num_rows - 1).filter(pa.array(keep[:-1]))
        yield from out.select(["owner", "at"]).to_batches()
    if held is not None:
        yield pa.RecordBatch.from_arrays([held.column("owner"), held.column("at")], ["owner", "at"])


PLACES = "o1 bigint, o2 bigint, first bigint, name bigint, x1 bigint, x2 bigint, more int, before int, near binary"


def _neighbourhoods(length: int):
    """Arrow rows per kept sample: where its strings start, a digest of all bytes they cover, and these bytes."""
    short = length - COVER + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

        for part, texts in text_slices(batches, "text"):
            out = [[] for _ in range(9)]
            for o1, o2, places, text in zip(*[part.column(c).to_pylist() for c in ("o1", "o2", "places")], texts.to_pylist(), strict=True):
                for packed in sorted(set(places)):
                    at, before, least = packed >> 14, packed >> 7 & 127, packed & 127
                    first, last = at - before, at - least
                    if last + length > len(text):  # another owner of the same hash
                        continue
                    near = text[first:last + length]
                    x = xxh3_128_intdigest(near + bytes((before, least)))
                    row = (o1, o2, first, _signed(xxh3_64_intdigest(text[at:at + short])), _signed(x >> 64), _signed(x & (1 << 64) - 1), last - first, before, near)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:6]], *[pa.array(c, pa.int32()) for c in out[6:8]], pa.array(out[8], pa.binary())],
                                             ["o1", "o2", "first", "name", "x1", "x2", "more", "before", "near"])

    return run


RUNS = "x1 bigint, x2 bigint, runs array<struct<a:int,b:int>>"


def _runs(flags: list[bool]) -> list[dict]:
    """Runs (first, last) of true entries."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _merge_in_task(length: int):
    """Which strings of neighbourhoods with the same name occur twice; rows come sorted by name."""

    def solve(group: list[tuple]) -> list[tuple]:
        seen: dict[bytes, bool] = {}
        if len(group) > 1:
            for _, _, more, near, n in group:
                for i in range(more + 1):
                    s = near[i:i + length]
                    seen[s] = n > 1 or s in seen
        out = []
        for x1, x2, more, near, n in group:
            flags = [True] * (more + 1) if n > 1 else [seen[near[i:i + length]] for i in range(more + 1)] if len(group) > 1 else [False]
            if any(flags):
                out.append((x1, x2, _runs(flags)))
        return out

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["x1", "x2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, group = None, []
        for batch in batches:
            found = []
            for own, *row in zip(*[batch.column(c).to_pylist() for c in ("name", "x1", "x2", "more", "near", "n")], strict=True):
                if own != name:
                    found += solve(group)
                    name, group = own, []
                group.append(tuple(row))
            yield rows(found)
        yield rows(solve(group))

    return run


PARTS = "x1 bigint, x2 bigint, more int, before int, near binary, n bigint, open int, low int, size int"


def _part_names(length: int):
    """Adds two 128-bit names to parts, the strings of a neighbourhood that start low .. low + size - 1 bytes before the sampled position.

    The core is what all strings of such a part have in common in any neighbourhood, the hull what this neighbourhood's strings cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            names = []
            for more, before, near, low, size in zip(*[batch.column(c).to_pylist() for c in ("more", "before", "near", "low", "size")], strict=True):
                near_at, far = max(low, before - more), min(low + size - 1, before)
                core = near[before - low:max(before - low, before - (low + size - 1) + length)]
                hull = near[before - far:before - near_at + length]
                names.append([xxh3_128_intdigest(part + bytes(tag)) for part, tag in ((core, (low, size, 0)), (hull, (near_at, far, 1)))])
            columns = [pa.array([_signed(w) for n in names for w in [n[i] >> 64 if high else n[i] & (1 << 64) - 1]], pa.int64())
                       for i in (0, 1) for high in (True, False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "c1", "c2", "h1", "h2"])

    return run


def _written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], n: str) -> DataFrame:
    """Inner join of rows with one row per key; keys that hold a hot share of the rows (counted in ``n``) are broadcast."""
    least = max(1.0, (keyed.agg(F.sum(n)).first()[0] or 0) * HOT_SHARE)
    keyed = keyed.withColumn("_hot", F.col(n) > least)
    hot = rows.join(F.broadcast(keyed.where("_hot")), on, "left")
    found = hot.where(F.col("_hot").isNotNull()).drop("_hot")
    rest = hot.where(F.col("_hot").isNull()).select(*rows.columns).join(keyed.where(~F.col("_hot")).hint("merge"), on).drop("_hot")
    return found.unionByName(rest)


def _many(near: DataFrame, length: int) -> DataFrame:
    """As ``_merge_in_task`` for names with any number of neighbourhoods, by recursion on longer names.

    The strings of a neighbourhood are halved again and again, at the same distances from the sampled position in all of
    them. A part whose core nobody else has is done; parts with the same hull are settled, and one of them goes on as their
    witness while others that are open share its core; the rest is halved. So a common passage with different surroundings
    costs a few parts each time, not all its strings.
    """
    ids = ["x1", "x2", "low"]
    size = 1 << (COVER - 1).bit_length()
    parts = near.select("x1", "x2", "more", "before", "near", "n", F.lit(1).alias("open"), F.lit(0).alias("low"), F.lit(size).alias("size"))
    settled = []
    while size:
        named = _written(parts.mapInArrow(_part_names(length), f"{PARTS}, c1 bigint, c2 bigint, h1 bigint, h2 bigint"), "suffix-parts", "zstd")
        keys = named.select("n", "open", F.inline(F.array(F.struct(F.col("c1").alias("k1"), F.col("c2").alias("k2")),
                                                          F.struct(F.col("h1").alias("k1"), F.col("h2").alias("k2")))))
        sums = keys.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.sum("open").alias("open"), F.count("*").alias("rows"))
        twice = _written(sums.where((F.col("n") > 1) & (F.col("open") > 0)).select("k1", "k2", "rows"), "suffix-twice")
        cores, hulls = (twice.select(F.col("k1").alias(f"{c}1"), F.col("k2").alias(f"{c}2"), "rows") for c in "ch")
        shared = _written(_join_hot(named, cores, ["c1", "c2"], "rows").drop("rows"), "suffix-parts", "zstd")
        done = _written(_join_hot(shared.select(*ids, "more", "before", "size", "open", "h1", "h2"), hulls, ["h1", "h2"], "rows"), "suffix-settled")
        far, near_at = F.least(F.col("low") + F.col("size") - 1, F.col("before")), F.greatest(F.col("low"), F.col("before") - F.col("more"))
        settled.append(done.where("open = 1").select("x1", "x2", F.struct((F.col("before") - far).alias("a"), (F.col("before") - near_at).alias("b")).alias("run")))
        witness = done.groupBy("h1", "h2").agg(F.min(F.struct(*ids)).alias("id")).select("id.*")
        size //= 2
        halves = F.explode(F.array("low", F.col("low") + size))
        rest = shared.join(done.select(*ids), ids, "left_anti").unionByName(
            shared.join(witness, ids, "left_semi").withColumn("n", F.lit(2).cast("bigint")).withColumn("open", F.lit(0)))
        parts = rest.select("x1", "x2", "more", "before", "near", "n", "open", halves.alias("low"), F.lit(size).alias("size"))
        parts = parts.where((F.col("low") <= F.col("before")) & (F.col("low") + size > F.col("before") - F.col("more")))
    every = settled[0]
    for s in settled[1:]:
        every = every.unionByName(s)
    return every.groupBy("x1", "x2").agg(F.collect_list("run").alias("runs"))


def _repeats(docs: DataFrame, length: int) -> DataFrame:
    """(o1, o2, ranges): byte ranges [a, b) of each text that lie in a string found twice."""
    parts = docs.select("o1", "text").mapInArrow(_sample_rows(length), "name bigint, owner bigint, at bigint")
    ordered = parts.repartitionByRange("name", "owner").sortWithinPartitions("name")
    places = _written(ordered.mapInArrow(_not_alone, "owner bigint, at bigint").groupBy("owner").agg(F.collect_set("at").alias("places")), "suffix-places")
    joined = docs.select("o1", "o2", "text").join(places.withColumnRenamed("owner", "o1"), "o1")
    kept = _written(joined.mapInArrow(_neighbourhoods(length), PLACES), "suffix-near", "zstd")
    near = _written(kept.groupBy("name", "x1", "x2", "more", "before").agg(F.first("near").alias("near"), F.count("*").alias("n")), "suffix-kinds", "zstd")
    crowded = near.groupBy("name").agg(F.count("*").alias("kinds")).where(F.col("kinds") > GROUP_ROWS)
    crowded = _written(crowded, "suffix-crowded")  # at most 1 / GROUP_ROWS of the neighbourhoods
    some = near.join(crowded.select("name"), "name", "left_anti")
    runs = some.repartition("name").sortWithinPartitions("name").mapInArrow(_merge_in_task(length), RUNS)
    if crowded.limit(1).count():
        runs = runs.unionByName(_many(near.join(crowded.select("name"), "name", "left_semi"), length))
    runs = _written(runs.join(near.select("x1", "x2", "n"), ["x1", "x2"]), "suffix-runs")
    found = _join_hot(kept.select("o1", "o2", "first", "x1", "x2"), runs, ["x1", "x2"], "n")
    ranges = F.transform("runs", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"] + length).alias("b")))
    return found.groupBy("o1", "o2").agg(F.flatten(F.collect_set(ranges)).alias("ranges"))


def _cut(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            out = [[] for _ in ADDED]
            for ranges, text in zip(part.column("ranges").to_pylist(), texts.to_pylist(), strict=True):
                merged: list[list[int]] = []
                for r in sorted((r["a"], r["b"]) for r in ranges or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                kept, at = [], 0
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                row = (len(text), sum(b - a for a, b in merged), len(merged), [{"a": a, "b": b} for a, b in merged], b"".join([*kept, text[at:]]))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()
            new = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *new], names=[*columns, *ADDED])

    return run


def _owner(doc_id: str, text: str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), F.col(doc_id), text_of(text)).alias(f"o{seed}") for seed in (1, 2)]


def remove_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text, as UTF-8 bytes, without the bytes of strings of ``length`` bytes that also start anywhere else.

    Judged on the input; strings do not cross texts, overlaps count, another place in the same text counts, and each row is
    a text of its own, so texts of ``length`` bytes that occur twice go whole. Null is empty. Returns the columns of ``docs`` but the
    text, and ``n_bytes``, ``n_removed``, ``n_spans``, ``removed`` (maximal runs [a, b)) and ``kept`` (bytes); input columns of these
    names are replaced. Null and repeated ids are kept, and no rows give no rows.

    The suffixes sorted first are a sample of which every string of ``length`` bytes has one within its first 96
    positions, chosen by content, so that equal strings have theirs at the same place. Suffixes of the sample are named by
    their common prefix; a name that no other suffix has is done, as no string it represents can occur twice. Of
    the rest, a neighbourhood (all bytes of the strings that one sampled suffix represents) that occurs twice settles all its
    strings at once. The strings that remain are merged with those of the same name and compared in full.
    """
    if length < COVER + GRAM:
        raise ValueError(f"length must be at least {COVER + GRAM}")
    inner = docs.select(*_owner(doc_id, text), F.col(text).alias("text"))
    columns = [c for c in docs.columns if c != text and c not in ADDED]
    rows = docs.select(*_owner(doc_id, text), F.struct(*columns, F.lit(0).alias("_")).alias("row"), F.col(text).alias("text"))
    cut = rows.join(_repeats(inner, length), ["o1", "o2"], "left").select("row", "text", "ranges")
    schema = T.StructType([cut.schema["row"], *T.StructType.fromDDL(
        "n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<a:bigint,b:bigint>>, kept binary").fields])
    done = cut.mapInArrow(_cut(["row"]), schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in columns], *ADDED)
