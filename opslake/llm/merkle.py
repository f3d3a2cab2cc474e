"""A Merkle manifest of a dataset: a digest per row, a tree per group, a tree over the groups, and a proof per row."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslake.plans.keys import null_safe_join
from opslake.plans.sizing import broadcast_if_small
from opslake.session import fresh_path

#: Children of a node, levels climbed per exchange, and the rows of one window group that these levels need.
ARITY, LEVELS = 3, 6
BLOCK = ARITY ** LEVELS
#: Nodes of a level, with their paths, that may be broadcast when paths are handed down.
BROADCAST_NODES = 20_000
OWN = ("leaf", "subroot", "root", "path")


def _nothing() -> Column:
    return F.unhex(F.lit(""))


def hashed(*digests: Column) -> Column:
    """SHA-256 (32 bytes) of the lower-case hex text of digests, concatenated."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*digests))), 256))


def text_of_digest(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (32 bytes) of fields, each ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give, level by level."""
    return F.aggregate(path, leaf, lambda node, at: hashed(at["left"], node, at["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a path from the leaf upwards, left to right, as one string of digests."""
    return F.aggregate(path, _nothing(), lambda all_, at: F.concat(all_, at["left"], at["right"]))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds each row's place within its ``group`` and the group's size, without a task that holds a group.

    Rows are range-partitioned and sorted by group and order; the task's own row numbers are written beside them, and
    the first number and count of each group in each partition give the offsets.
    """
    ranged = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    numbered = _written(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    runs = numbered.groupBy("group", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    by_part = Window.partitionBy("group").orderBy("part")
    before = F.coalesce(F.sum("rows").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("group", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("group")).alias("n"))
    joined = null_safe_join(numbered.withColumn("part", F.shiftright("at", 33)), broadcast_if_small(starts, BROADCAST_NODES), ["group", "part"])
    return joined.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _climb(nodes: DataFrame) -> DataFrame:
    """LEVELS levels above nodes (group, pos, n, node): adds ``block``, ``top`` (on each block's first row) and ``path``.

    All levels share one exchange and one sort. The node of a level stands on its first row, so that siblings lie a fixed
    number of rows away: lag and lead by that offset, masked by the slot within the run and by the run's length, give them,
    and the row of the first child hashes the parent. The rows below a node take its siblings from the last row that has some.
    """
    frame = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("d0", F.col("node"))
    near = Window.partitionBy("group", "block").orderBy("pos")
    for k in range(LEVELS):
        step, own = ARITY ** k, f"d{k}"
        others = {f"s{j}": (F.lag(own, -j * step) if j < 0 else F.lead(own, j * step)).over(near) for j in range(1 - ARITY, ARITY) if j}
        place = F.floor(F.col("pos") / step)
        slot = place % ARITY
        level_n = F.floor((F.col("n") + step - 1) / step)
        run = F.least(F.lit(ARITY), level_n - place + slot)
        frame = frame.select("*", *[c.alias(name) for name, c in others.items()])
        left = F.concat(*[F.when(slot >= -j, F.col(f"s{j}")).otherwise(_nothing()) for j in range(1 - ARITY, 0)])
        right = F.concat(*[F.when(slot + j < run, F.col(f"s{j}")).otherwise(_nothing()) for j in range(1, ARITY)])
        grows = level_n > 1
        here = grows & (F.col("pos") % step == 0)
        parent = F.when(grows & (F.col("pos") % (step * ARITY) == 0), hashed(F.col(own), right)).when(~grows & (F.col("pos") == 0), F.col(own))
        frame = frame.select("*", F.when(here, F.struct(left.alias("left"), right.alias("right"))).alias(f"e{k}"),
                             parent.alias(f"d{k + 1}")).drop(*others)
    upto = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.array_compact(F.array(*[F.last(f"e{k}", ignorenulls=True).over(upto) for k in range(LEVELS)]))
    return frame.select(*nodes.columns, "block", F.col(f"d{LEVELS}").alias("top"), path.alias("path"))


def _tree(rows: DataFrame, order: list[str], over) -> DataFrame:
    """Adds subroot, root and path to rows (group, node, ...); ``over`` maps (group, subroot) to the tree above the groups."""
    nodes, passes = _placed(rows, order), []
    while True:
        passes.append(_written(_climb(nodes), "merkle-level"))
        nodes = passes[-1].where(F.col("pos") % BLOCK == 0).select(
            "group", F.col("block").alias("pos"), F.floor((F.col("n") + BLOCK - 1) / BLOCK).alias("n"), F.col("top").alias("node"))
        if nodes.where("n > 1").limit(1).count() == 0:
            break
    above = over(nodes.select("group", F.col("node").alias("subroot")))
    for level in reversed(passes):
        up = above.select("group", F.col("pos").alias("block"), "subroot", "root", F.col("path").alias("rest"))
        down = null_safe_join(level, broadcast_if_small(up, BROADCAST_NODES), ["group", "block"])
        above = down.withColumn("path", F.concat("path", "rest")).drop("block", "top", "n", "rest")
    return above


def _over_nothing(groups: DataFrame) -> DataFrame:
    return groups.select("*", F.lit(0).cast("long").alias("pos"), F.col("subroot").alias("root"),
                         F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))


def _over_groups(groups: DataFrame) -> DataFrame:
    found = _tree(groups.select(F.lit(0).alias("group"), F.col("group").alias("name"), F.col("subroot").alias("node")), ["name"], _over_nothing)
    return found.select(F.col("name").alias("group"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), "root", "path")


def manifest(docs: DataFrame, leaf: Column, group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, group root, dataset root and proof of every row.

    Within a group, leaves stand by ``order`` (null first, ties by digest; rows alike in digest and in all that is kept are
    interchangeable). While a level has several nodes, each run of three consecutive ones (the last run may be shorter, even one) becomes the
    digest of their concatenated hex texts. The roots of groups, by name (null first, then bytewise), make a tree of the
    same kind. ``keep`` names the columns to carry along; those named like an output are replaced. Returns the kept columns,
    ``leaf``, ``subroot``, ``root`` (32 bytes each) and ``path``: one (left, right) pair of concatenated sibling digests per
    level from the leaf to the root, which ``folded`` and ``siblings`` read. No rows give no rows.

    Texts are read once; all else works on digests. A group of any size is spread over blocks of 729 rows; each exchange
    climbs six levels, so that a thousand million rows need four. Paths come down by joins on (group, block).
    """
    keep = {order: F.col(order), group: F.col(group)} if keep is None else keep
    kept = [c for c in keep if c not in OWN]
    rows = docs.select(F.col(group).alias("group"), F.col(order).alias("key"), leaf.alias("node"),
                       F.struct(*[keep[c].alias(c) for c in kept], F.lit(0).alias("_")).alias("kept"))
    found = _tree(_written(rows, "merkle-leaves"), ["key", "node", "kept"], _over_groups)
    return found.select(*[F.col("kept").getField(c).alias(c) for c in kept], F.col("node").alias("leaf"), "subroot", "root", "path")
