"""Roll raw events up into hourly per-service telemetry."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opslake.schema import REQUIRED_COLUMNS

# Service that an event type belongs to; error events are spread by user.
SERVICE_OF_TYPE = {"view": "api_gateway", "signup": "auth_service", "click": "orders_service", "purchase": "database"}
SERVICE_OF_ERROR = ("api_gateway", "auth_service", "orders_service", "database")


def event_service() -> Column:
    typed = F.lit(None).cast("string")
    for event_type, service in SERVICE_OF_TYPE.items():
        typed = F.when(F.col("event_type") == event_type, F.lit(service)).otherwise(typed)
    slot = F.pmod(F.col("user_id"), F.lit(len(SERVICE_OF_ERROR)))
    failed = F.lit(SERVICE_OF_ERROR[-1])
    for i, service in reversed(list(enumerate(SERVICE_OF_ERROR[:-1]))):
        failed = F.when(slot == i, F.lit(service)).otherwise(failed)
    return F.when(F.col("event_type") == "error", failed).otherwise(typed)


def event_measures(events: DataFrame) -> DataFrame:
    """Per-event columns the roll-up sums: integer cents and the ``k`` property."""
    return events.select(
        "event_id", "ts", "user_id",
        event_service().alias("service"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (F.col("event_type") == "error").cast("int").alias("failed"),
    )


def telemetry_columns(n: Column, cents: Column, failed: Column, users: Column, max_cents: Column, sum_k: Column,
                      max_k: Column) -> list[Column]:
    """The ten metrics from the sums of one (hour, service) cell."""
    nd, cd, ud = n.cast("double"), cents.cast("double"), users.cast("double")
    return [
        F.least(F.lit(100.0), max_cents.cast("double") / F.lit(500.0)).alias("cpu_usage_pct"),
        (sum_k.cast("double") / nd).alias("memory_usage_pct"),
        max_k.cast("double").alias("disk_usage_pct"),
        (cd / F.lit(360000.0)).alias("network_in_mbps"),
        (sum_k.cast("double") / F.lit(3600.0)).alias("network_out_mbps"),
        (nd / F.lit(3600.0)).alias("request_rate_rps"),
        (cd / (F.lit(100.0) * nd)).alias("latency_ms"),
        (failed.cast("double") / nd).alias("error_rate"),
        users.cast("bigint").alias("active_connections"),
        F.least(F.lit(1.0), ud / F.lit(50.0)).alias("connection_utilization"),
    ]


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """One row per (hour, service).

    Sums are first taken per (hour, service, user) and combined map-side, so neither a busy service nor a busy user puts
    more than its distinct users into one task.
    """
    per_user = (
        event_measures(events)
        .groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("timestamp"), "service", "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.sum("failed").alias("failed"),
             F.max("cents").alias("max_cents"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))
    )
    cells = per_user.groupBy("timestamp", "service").agg(
        F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.sum("failed").alias("failed"),
        F.count(F.lit(1)).alias("users"), F.max("max_cents").alias("max_cents"), F.sum("sum_k").alias("sum_k"),
        F.max("max_k").alias("max_k"))
    names = ("n", "cents", "failed", "users", "max_cents", "sum_k", "max_k")
    return cells.select("timestamp", "service", *telemetry_columns(*[F.col(c) for c in names])).select(*REQUIRED_COLUMNS)
