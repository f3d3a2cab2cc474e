"""Row-frame windows over long ordered histories, split so that no task holds a whole history.

A window ``partitionBy(service)`` gives one task per service. Here the history of a key is cut into slices; each slice
gets a copy of the ``lookback`` rows that precede it (its halo), windows run per (key, slice), and halo rows are dropped.
The result is the same as for the plain window, for any slice width and however thin the slices are. The input is passed
three times (slice sizes, slice tails, the windows themselves), so it is settled first unless it is a plain scan.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslake.functions.scalars import epoch_seconds
from opslake.plans.keys import null_safe_join
from opslake.plans.sizing import broadcast_if_small, settle, use_spread_plan

DAY = 86_400


def time_slice(ts: Column, seconds: int | Column = DAY) -> Column:
    return F.floor(epoch_seconds(ts) / (seconds if isinstance(seconds, Column) else F.lit(seconds))).cast("bigint")


def fitting_time_slice(ts: str, keys: Sequence[str], target_rows: int = 1_000_000,
                       least_rows: int = 256) -> Callable[[DataFrame], DataFrame]:
    """Adds ``_slice``: days, but shorter where a day of the key has more than ``target_rows`` rows, and as many days as
    it takes to hold about ``least_rows`` where a key has few rows a day, so that its halos stay small beside its rows.

    One grouped count over the key and time columns gives the width per key; the widths are joined in, by broadcast if
    counted to be few.
    """
    def add(df: DataFrame) -> DataFrame:
        per_day = df.groupBy(*keys, time_slice(F.col(ts)).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
        days = F.ceil(F.lit(least_rows) / F.avg("_n"))
        width = F.when(F.max("_n") > target_rows, F.greatest(F.lit(1), F.floor(F.lit(DAY * target_rows) / F.max("_n")))).otherwise(DAY * days)
        widths = per_day.groupBy(*keys).agg(width.cast("bigint").alias("_width"))
        joined = null_safe_join(df, broadcast_if_small(widths), keys, "left")
        return joined.withColumn("_slice", time_slice(F.col(ts), F.col("_width"))).drop("_width")

    return add


def over_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 compute: Callable[[DataFrame, list[str]], DataFrame], lookback: int,
                 slice_by: Column | Callable[[DataFrame], DataFrame], mode: str = "auto") -> DataFrame:
    """Run ``compute(frame, partition_columns)``, whose windows look back at most ``lookback`` rows.

    ``slice_by``, or the ``_slice`` that it adds to the frame, must not decrease along ``order`` within a key; rows with
    equal slice go to one task.
    """
    keys, order = list(keys), list(order)
    if not use_spread_plan(df, mode):
        return compute(df, keys)

    df = settle(df)
    rows = df.withColumn("_slice", slice_by) if isinstance(slice_by, Column) else slice_by(df)
    halo = _halo_rows(rows, keys, order, lookback)
    both = rows.withColumn("_halo", F.lit(False)).unionByName(halo)
    return compute(both, keys + ["_slice"]).where(~F.col("_halo")).drop("_halo", "_slice")


def _halo_rows(rows: DataFrame, keys: list[str], order: list[str], lookback: int) -> DataFrame:
    """For every slice, the ``lookback`` rows of its key that come right before it.

    Positions count rows of the key before the slice, so a halo may reach over several thin slices. The slice that starts
    at position s needs the rows at s-lookback .. s-1; starts are matched on s div lookback, which leaves two candidates
    per row and keeps the join an equi-join. Null keys and the slice of null times are groups like any other.
    """
    by_slice = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(by_slice), F.lit(0)))
    )
    from_end = Window.partitionBy(*keys, "_slice").orderBy(*[F.desc(c) for c in order])
    last = rows.withColumn("_back", F.row_number().over(from_end)).where(F.col("_back") <= lookback)
    tails = (
        null_safe_join(last, slices, [*keys, "_slice"])
        .withColumn("_pos", F.col("_start") + F.col("_n") - F.col("_back"))
        .drop("_start", "_n", "_back", "_slice")
        .withColumn("_cell", F.explode(F.array_distinct(F.array(
            F.floor((F.col("_pos") + 1) / lookback), F.floor((F.col("_pos") + lookback) / lookback)))))
    )
    starts = slices.select(*keys, "_slice", "_start", F.floor(F.col("_start") / lookback).alias("_cell"))
    return (
        null_safe_join(tails, starts, [*keys, "_cell"])
        .where((F.col("_start") > F.col("_pos")) & (F.col("_start") <= F.col("_pos") + lookback))
        .drop("_cell", "_start", "_pos")
        .withColumn("_halo", F.lit(True))
    )
