"""Mix sources to target weights by a splitting tree over blocks of documents."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opslake.llm.rows import text_of
from opslake.session import fresh_path

#: Sources a mix may have; the plan holds a few numbers for each on the driver. More are refused, never dropped.
MAX_SOURCES = 100_000
#: Documents a block aims at, and blocks a source may have; blocks of a larger source grow instead.
BLOCK_DOCS, MAX_BLOCKS = 128, 4096
#: Words that one task writes, and numbers (shards x sources) that the splitting tree may make on the driver.
PART_WORDS, MOST_QUOTAS = 2_000_000, 10_000_000

ADDED = ("size", "source_size", "target", "copies")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def fill_targets(sizes: Sequence[int], weights: Sequence[int], cap: int = 3) -> list[float]:
    """Share the sum of all sizes by weight; a source above ``cap`` times its size stops there and the rest is shared anew."""
    total, full = sum(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(cap * s for s, f in zip(sizes, full, strict=True) if f)
        mass = sum(w for w, f in zip(weights, full, strict=True) if not f)
        share = [float(cap * s) if f else w * rest / mass for s, w, f in zip(sizes, weights, full, strict=True)]
        over = [i for i, (x, s) in enumerate(zip(share, sizes, strict=True)) if not full[i] and x > cap * s]
        if not over:
            return share
        for i in over:
            full[i] = True


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Deal exact quotas of blocks to shards (shards x sources) by a binary tree.

    A node gives its left half a draw without replacement from the blocks it holds (multivariate hypergeometric), the
    right half the rest; each node has a generator of its own, so any node can be drawn again alone.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, held = todo.pop()
        if hi - lo == 1:
            out[lo] = held
            continue
        mid = (lo + hi) // 2
        n = int(held.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(held, n, method="marginals") if len(held) else held
        todo += [(lo, mid, left), (mid, hi, held - left)]
    return out


@dataclass
class MixPlan:
    """What deals the documents: numbers per source (a small frame) and shards per block (one row per block)."""

    sources: DataFrame
    blocks: DataFrame
    seed: int
    shards: int
    parts: int


def _key(doc_id: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(doc_id), text_of(text))


def _located(df: DataFrame, source: Column, sources: DataFrame, seed: int) -> DataFrame:
    """Add the source's numbers, the block and the block's place in the order of the last passes."""
    out = df.join(F.broadcast(sources), source.eqNullSafe(F.col("_name")), "left").drop("_name")
    out = out.withColumn("_block", F.pmod(F.col("_key"), F.col("_blocks")))
    return out.withColumn("_order", F.xxhash64(F.lit(seed), F.lit("order"), F.col("_src"), F.col("_block")))


def _taken_in(fills: Column, number: Column) -> Column:
    """Whether a fill takes the document in this pass: it is no larger than the room there was and not behind the fill's end."""
    return F.exists(fills, lambda f: (f["pass"] == number) & (F.col("size") <= f["room"]) & (
        (F.col("_order") < f["order"]) | ((F.col("_order") == f["order"]) & (F.col("_key") <= f["key"]))))


FILLS = "array<struct<pass:int,room:double,order:bigint,key:bigint>>"
LAST = (1 << 63) - 1


def _fill(spark: SparkSession, held: DataFrame, rooms: dict[int, float], passes: dict[int, int], cap: int) -> dict[int, list[tuple]]:
    """Fills that bring each source's words up to its target: per source (pass, room, order, key).

    Each round takes, in the order of the blocks and within a block by hash, documents no larger than the room and not taken in this pass,
    until the next one does not fit. A pass in which nothing fits any more gives way to the next, up to ``cap``, so what is missing in the end
    is less than any document that could still be taken. All sources go through a round together; a round sums blocks and then looks at one block per source.
    """
    fills: dict[int, list[tuple]] = {i: [] for i in rooms}
    now = dict(passes)
    while open_ := [(i, now[i], rooms[i], fills[i]) for i in rooms if rooms[i] > 0 and now[i] < cap]:
        step = spark.createDataFrame(open_, f"_src int, _pass int, _room double, _fills {FILLS}")
        slots = held.join(F.broadcast(step), "_src").where((F.col("size") > 0) & (F.col("size") <= F.col("_room")) & ~_taken_in(F.col("_fills"), F.col("_pass")))
        upto = Window.partitionBy("_src").orderBy("_order", "_block")
        sums = slots.groupBy("_src", "_block", "_order", "_room").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
        crossed = F.min(F.when(F.col("upto") > F.col("_room"), F.struct("_order", "_block", (F.col("upto") - F.col("words")).alias("before"))))
        found = {r["_src"]: r for r in sums.groupBy("_src").agg(F.sum("words").alias("all"), crossed.alias("edge")).collect()}
        edges = [(i, r["edge"]["_block"], rooms[i] - r["edge"]["before"]) for i, r in found.items() if r["edge"]]
        inside = {}
        if edges:
            edge = spark.createDataFrame(edges, "_src int, _block bigint, _left double")
            summed = slots.join(F.broadcast(edge), ["_src", "_block"]).withColumn("cum", F.sum("size").over(Window.partitionBy("_src", "_block").orderBy("_key")))
            inside = {r["_src"]: r for r in summed.where("cum <= _left").groupBy("_src").agg(F.max("_key").alias("last"), F.max("cum").alias("cum")).collect()}
        for i, number, room, _ in open_:
            r = found.get(i)
            if r is None or r["edge"] is None:
                if r is not None:
                    fills[i].append((number, room, LAST, LAST))
                    rooms[i] -= r["all"]
                now[i] += 1
                continue
            last = inside.get(i)
            took = r["edge"]["before"] + (last["cum"] if last else 0)
            if not took:  # only repeated rows, which are taken together or not at all
                now[i] += 1
                continue
            fills[i].append((number, room, r["edge"]["_order"], last["last"] if last else -LAST - 1))
            rooms[i] -= took
    return fills


def plan_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, shards: int | None = None, seed: int = 7,
             doc_id: str = "doc_id", text: str = "text", source: str = "source") -> MixPlan:
    """Find each source's target and deal its blocks to shards.

    A block is the documents of a source that share a hash of id and text modulo the number of blocks. A target takes
    whole passes over its source and then documents that fit what is missing (``_fill``), so the words taken are below the target by less than
    the smallest document that could still be taken, and nothing depends on the partitioning of the input. The number of shards follows from the words taken, if not given.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "sizes")
    docs.select(F.col(source).cast("string").alias("source"), n_words(text_of(text)).alias("size"),
                _key(doc_id, text, seed).alias("_key")).write.parquet(path)
    narrow = spark.read.schema("source string, size long, _key long").parquet(path)
    per = narrow.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    targets = fill_targets([r["words"] for r in per], [weights[i % len(weights)] for i in range(len(per))], cap) if per else []
    passes = {i: int(t // r["words"]) if r["words"] else 0 for i, (r, t) in enumerate(zip(per, targets, strict=True))}
    rows = [(r["source"], i, r["words"], t, passes[i], max(1, min(MAX_BLOCKS, -(-r["n"] // BLOCK_DOCS)))) for i, (r, t) in enumerate(zip(per, targets, strict=True))]
    columns = "_name string, _src int, source_size long, target double, _passes int, _blocks long"
    held = _located(narrow, F.col("source"), spark.createDataFrame(rows, columns), seed)
    fills = _fill(spark, held, {i: t - passes[i] * r["words"] for i, (r, t) in enumerate(zip(per, targets, strict=True)) if r["words"]}, passes, cap)
    sources = spark.createDataFrame([(*r, fills.get(r[1], [])) for r in rows], f"{columns}, _fills {FILLS}")

    wanted = max(1, -(-int(sum(targets)) // PART_WORDS))
    if shards is None:
        shards = max(1, min(wanted, MOST_QUOTAS // max(1, len(rows))))
    path = fresh_path(spark, "blocks")
    held = _located(narrow, F.col("source"), sources, seed)
    units = held.select("_src", "_block", F.explode(_passes_of(cap)).alias("_pass")).distinct()
    rank = Window.partitionBy("_src", "_pass").orderBy(F.xxhash64(F.lit(seed), F.col("_pass"), F.col("_block")), "_block")
    units.withColumn("_rank", F.row_number().over(rank) - 1).write.parquet(path)
    units = spark.read.schema("_src int, _block bigint, _pass int, _rank int").parquet(path)
    counts = {(r["_src"], r["_pass"]): r["count"] for r in units.groupBy("_src", "_pass").count().collect()}
    n_passes = max((p for _, p in counts), default=-1) + 1
    quotas = [sum(counts.get((i, p), 0) for p in range(n_passes)) for i in range(len(rows))]
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    dealt = spark.createDataFrame(
        [(i, p, sum(counts.get((i, q), 0) for q in range(p)), [int(x) for x in ends[:, i]]) for i, p in sorted(counts)],
        "_src int, _pass int, _start long, _ends array<long>")
    shard = F.size(F.filter("_ends", lambda e: e <= F.col("_start") + F.col("_rank")))
    placed = units.join(F.broadcast(dealt), ["_src", "_pass"]).withColumn("_shard", shard)
    blocks = placed.groupBy("_src", "_block").agg(F.collect_list(F.struct(F.col("_pass").alias("pass"), F.col("_shard").alias("shard"))).alias("_plan"))
    return MixPlan(sources, blocks, seed, shards, -(-wanted // shards))


def _passes_of(cap: int) -> Column:
    """The passes that take the document: all whole ones and those of its fills."""
    return F.filter(F.sequence(F.lit(0), F.lit(cap - 1)), lambda p: (p < F.col("_passes")) | _taken_in(F.col("_fills"), p))


def _order(doc_id: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("place"), F.col(doc_id), text_of(text))


def assign(docs: DataFrame, plan: MixPlan, doc_id: str = "doc_id", text: str = "text", source: str = "source", cap: int = 3) -> DataFrame:
    """Add size, source_size, target and copies: the (pass, shard, place) of each time the mix takes the document.

    Copies of a shard are in the order of their place, a hash. Null text has size 0; repeated rows are taken together; input
    columns with the names of the added ones are replaced, all others pass through. No rows give none.
    """
    # Sizes are taken before the join, so that a caller who needs no text has none of it shuffled.
    cols = [c for c in docs.columns if c not in ADDED]
    df = docs.select(F.struct(*cols).alias("_row"), F.col(source).cast("string").alias("_of"), n_words(text_of(text)).alias("size"),
                     _key(doc_id, text, plan.seed).alias("_key"), _order(doc_id, text, plan.seed).alias("_place"))
    df = _located(df, F.col("_of"), plan.sources, plan.seed).join(plan.blocks, ["_src", "_block"], "left").withColumn("_in", _passes_of(cap))
    taken = F.filter("_plan", lambda c: F.array_contains(F.col("_in"), c["pass"]))
    copies = F.transform(F.coalesce(taken, F.array().cast("array<struct<pass:int,shard:int>>")), lambda c: F.struct(
        c["pass"].alias("pass"), c["shard"].alias("shard"), F.xxhash64(c["pass"], F.col("_place")).alias("place")))
    return df.select(*[F.col("_row").getField(c).alias(c) for c in cols], "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, shards: int | None = None, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        **plan) -> DataFrame:
    """The mixed documents, one row per copy, dealt to shards and shuffled within each.

    Size is the number of words of a text (null: 0). Sources in the order of their code points, null last, weigh 1, 2, 3,
    repeating; targets share all sizes and stop at ``cap`` times their source's size. A document is taken as a whole, at
    most ``cap`` times; documents without words come along with the whole passes of their source. Repeated rows
    of one id and text are taken together. Returns the columns of ``docs`` with mix_shard and mix_pass, which replace input columns
    of these names; no rows give none. Reruns give the same rows in the same shards, in the order of a hash. A shard with many words
    is written by several tasks, each with a run of that order, so that no task grows with the input.
    """
    p = plan_mix(docs, shards=shards, seed=seed, doc_id=doc_id, text=text, source=source, **plan)
    cols = [c for c in docs.columns if c not in ("mix_shard", "mix_pass")]
    rows = docs.select(F.struct(*cols).alias("row"), F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    taken = assign(rows, p, "_doc", "_text", "_source", plan.get("cap", 3)).select("row", F.explode("copies").alias("c"))
    part = F.floor((F.col("c.place").cast("double") / 2.0 ** 64 + 0.5) * p.parts)
    spread = taken.withColumn("part", part).repartition(p.shards * p.parts, F.col("c.shard"), "part").sortWithinPartitions("c.shard", "part", "c.place")
    return spread.select(*[F.col("row").getField(c).alias(c) for c in cols], F.col("c.shard").alias("mix_shard"), F.col("c.pass").alias("mix_pass"))
