"""Event to telemetry roll-up and exact-copy removal on a stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslake.schema import REQUIRED_COLUMNS
from opslake.sources.rollup import event_measures, telemetry_columns


def stream_telemetry(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Hourly telemetry in append mode: a window is emitted once, when the watermark has passed its end.

    State is first kept per (hour, service, user), then per (hour, service), as in the batch roll-up, so a busy service
    is not one ever-growing set in one state row.
    """
    timed = event_measures(events).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    per_user = timed.groupBy(F.window("ts", "1 hour").alias("window"), "service", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.sum("failed").alias("failed"),
        F.max("cents").alias("max_cents"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))
    cells = per_user.groupBy("window", "service").agg(
        F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.sum("failed").alias("failed"),
        F.count(F.lit(1)).alias("users"), F.max("max_cents").alias("max_cents"), F.sum("sum_k").alias("sum_k"),
        F.max("max_k").alias("max_k"))
    names = ("n", "cents", "failed", "users", "max_cents", "sum_k", "max_k")
    return cells.select(
        F.col("window.start").cast("timestamp_ntz").alias("timestamp"), "service",
        *telemetry_columns(*[F.col(c) for c in names])).select(*REQUIRED_COLUMNS)


def stream_distinct(rows: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """One row per key; copies are caught while they are no further apart than ``lateness``."""
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.dropDuplicatesWithinWatermark(keys)
