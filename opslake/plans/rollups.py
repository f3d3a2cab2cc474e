"""Aggregates of rows over many overlapping time windows, from a roll-up of time blocks."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from opslake.plans.intervals import _micros
from opslake.plans.sizing import broadcast_if_small, has_at_most, settle

#: Blocks of a level that make one of the next, and rows of one key that a block of the lowest level holds on average.
FAN, ROWS_PER_BLOCK = 8, 64
#: Windows so few that their pieces are broadcast.
FEW_WINDOWS = 2_000
#: How a partial value of rows or blocks joins another.
MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Part:
    """A value per row and how it is merged: ``sum``, ``max`` or ``min``."""

    value: Column
    merge: str


def _blocks(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _up(c: Column, width: int) -> Column:
    return ((c + F.pmod(-c, F.lit(width))) / width).cast("bigint")


def _down(c: Column, width: int) -> Column:
    return ((c - F.pmod(c, F.lit(width))) / width).cast("bigint")


def _at_level(k: int):
    return lambda block: F.struct(F.lit(k).alias("_level"), block.alias("_block"))


def window_totals(rows: DataFrame, windows: DataFrame, parts: dict[str, Part], window_id: str = "incident_id", key: str = "service",
                  width: int | None = None) -> DataFrame:
    """One row per (window, key with rows in it) with the merged parts of the rows in the window.

    ``rows`` has ``timestamp`` and the key, ``windows`` the id and ``from_ts``, ``to_ts`` (both ends closed; empty or unbounded ones
    give nothing). Rows are aggregated once to blocks of time and these to ever larger ones, FAN to one, in a second
    aggregate of what is left. A window is made of whole blocks, at most 2 (FAN - 1) per level, and of the rows in the two blocks at its edges that
    it covers in part; so long windows that overlap a thousandfold read blocks, not rows. ``width`` is that of the lowest
    blocks in microseconds; by default it follows from the number of rows.
    """
    ts = _micros(F.col("timestamp"))
    n, low, high, kinds = rows.agg(F.count("*"), F.min(ts), F.max(ts), F.approx_count_distinct(key)).first()
    low, high = (low, high) if low is not None else (0, 0)
    span = high - low + 1
    width = width or max(1_000_000, span * ROWS_PER_BLOCK * max(1, kinds) // max(1, n))
    levels = 0
    while width * FAN ** levels < span:
        levels += 1
    names = list(parts)
    merged = [MERGE[p.merge](c).alias(c) for c, p in parts.items()]
    placed = rows.select(key, ts.alias("_at"), *[p.value.alias(c) for c, p in parts.items()]).withColumn("_block", _down(F.col("_at"), width))
    lowest = settle(placed.groupBy(key, "_block").agg(*merged), "blocks")
    taller = lowest.select(key, *names, F.explode(F.array(*[
        F.struct(F.lit(k).alias("_level"), _down(F.col("_block"), FAN ** k).alias("_block")) for k in range(1, levels + 1)])).alias("_up")) if levels else None
    tree = lowest.withColumn("_level", F.lit(0))
    if taller is not None:
        tree = tree.unionByName(taller.select(key, *names, "_up.*").groupBy(key, "_level", "_block").agg(*merged))

    begin, end = F.greatest(_micros(F.col("from_ts")), F.lit(low)), F.least(_micros(F.col("to_ts")) + 1, F.lit(high + 1))
    spans = windows.where(F.col("from_ts").isNotNull() & F.col("to_ts").isNotNull()).select(
        window_id, begin.alias("_a"), end.alias("_b")).where("_a < _b").distinct()
    few = has_at_most(spans, FEW_WINDOWS)
    side = F.broadcast if few else broadcast_if_small
    first, last = _up(F.col("_a"), width), _down(F.col("_b"), width)
    runs = []
    for k in range(levels + 1):
        l, r = _up(first, FAN ** k), _down(last, FAN ** k)
        up_l, up_r = _up(first, FAN ** (k + 1)) * FAN, _down(last, FAN ** (k + 1)) * FAN
        split = (up_l < up_r) & F.lit(k < levels)
        ids = F.when(split, F.concat(_blocks(l, up_l - 1), _blocks(up_r, r - 1))).otherwise(_blocks(l, r - 1))
        runs.append(F.transform(ids, _at_level(k)))
    pieces = spans.select(window_id, F.explode(F.concat(*runs)).alias("_piece")).select(window_id, "_piece.*")
    whole = tree.join(side(pieces), ["_level", "_block"]).select(window_id, key, *names)
    inside = first < last
    edges = spans.select(window_id, F.explode(F.when(inside, F.array(
        F.struct(F.col("_a").alias("_from"), (first * width).alias("_upto")), F.struct((last * width).alias("_from"), F.col("_b").alias("_upto")))).otherwise(
        F.array(F.struct(F.col("_a").alias("_from"), F.col("_b").alias("_upto"))))).alias("_e")).select(window_id, "_e.*").where("_from < _upto")
    edges = edges.withColumn("_block", F.explode(_blocks(_down(F.col("_from"), width), _down(F.col("_upto") - 1, width))))
    partly = placed.join(side(edges), ["_block"]).where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_upto"))).select(window_id, key, *names)
    return whole.unionByName(partly).groupBy(window_id, key).agg(*merged)
