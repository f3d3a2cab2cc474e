"""Ground-truth labels from incident ranges, for whole tables of incidents at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opslake.functions.scalars import shift_seconds
from opslake.plans.intervals import attach_max


def affected() -> Column:
    """The affected list; when absent, the root cause service alone, or nothing without one."""
    root = F.col("root_cause_service")
    return F.coalesce(F.col("affected_services"),
                      F.when(root.isNotNull(), F.array(root)).otherwise(F.array().cast("array<string>")))


def _found(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def incident_labels(telemetry: DataFrame, incidents: DataFrame, width: int | None = None) -> DataFrame:
    """``timestamp, service, is_incident, is_root_cause, incident_id, incident_type``.

    The root flag does not depend on the affected list. When incidents overlap, id and type come from the one listed last.
    """
    root = F.col("root_cause_service")
    named = incidents.withColumn("_affected", affected())
    ranges = named.select(
        F.explode(F.array_distinct(F.array_compact(F.concat("_affected", F.array(root))))).alias("service"),
        "ord", F.col("start_time").alias("from_ts"), F.col("end_time").alias("to_ts"),
        "incident_id", "incident_type", "_affected", root.alias("_root"))
    hit = F.array_contains("_affected", F.col("service"))
    rows = attach_max(telemetry.select("timestamp", "service"), ranges, True, {
        "_last": F.when(hit, F.struct("ord", "incident_id", "incident_type")),
        "_is_root": F.coalesce(F.col("_root") == F.col("service"), F.lit(False))}, width)
    return rows.select(
        "timestamp", "service", F.col("_last").isNotNull().alias("is_incident"), _found("_is_root").alias("is_root_cause"),
        F.col("_last.incident_id").alias("incident_id"), F.col("_last.incident_type").alias("incident_type"))


def _by_service(incidents: DataFrame, start: Column, end: Column, *payload: Column) -> tuple[DataFrame, DataFrame]:
    """Ranges for named services, and ranges of incidents whose affected list is empty, which match every service."""
    base = incidents.withColumn("_affected", affected())
    cols = ["ord", start.alias("from_ts"), end.alias("to_ts"), *payload]
    named = base.select(F.explode("_affected").alias("service"), *cols).distinct()
    return named, base.where(F.size("_affected") == 0).select(*cols)


def severity_labels(telemetry: DataFrame, incidents: DataFrame, width: int | None = None) -> DataFrame:
    """``timestamp, service, severity``: lower-cased severity of the last listed matching incident, else null."""
    level = F.lower(F.coalesce(F.col("severity"), F.lit("medium"))).alias("level")
    named, everywhere = _by_service(incidents, F.col("start_time"), F.col("end_time"), level)
    last = F.struct("ord", "level")
    rows = attach_max(telemetry.select("timestamp", "service"), named, True, {"_named": last}, width)
    rows = attach_max(rows, everywhere, False, {"_every": last}, width)
    return rows.select("timestamp", "service", F.greatest("_named", "_every")["level"].alias("severity"))


def horizon_labels(telemetry: DataFrame, incidents: DataFrame, horizon_seconds: float, service_specific: bool = True,
                   lead_time_only: bool = False, width: int | None = None) -> DataFrame:
    """``timestamp, service, is_incident_in_horizon``: an incident is active or starts within the horizon.

    ``lead_time_only`` drops rows at or after the start of the incident.
    """
    begin = shift_seconds(F.col("start_time"), -horizon_seconds)
    end = F.col("start_time") if lead_time_only else F.col("end_time")
    named, everywhere = _by_service(incidents, begin, end)
    if not service_specific:
        everywhere = incidents.select("ord", begin.alias("from_ts"), end.alias("to_ts"))
    hit = F.lit(True)
    rows = attach_max(telemetry.select("timestamp", "service"), everywhere, False, {"_every": hit}, width, lead_time_only)
    found = _found("_every")
    if service_specific:
        rows = attach_max(rows, named, True, {"_named": hit}, width, lead_time_only)
        found = found | _found("_named")
    return rows.select("timestamp", "service", found.alias("is_incident_in_horizon"))


def active_window_labels(telemetry: DataFrame, incidents: DataFrame, width: int | None = None) -> DataFrame:
    """``timestamp, service, incident_label, severity_label``: every service counts while an incident is active."""
    ranges = incidents.select("ord", F.col("start_time").alias("from_ts"), F.col("end_time").alias("to_ts"),
                              F.coalesce(F.col("severity"), F.lit("critical")).alias("level"))
    rows = attach_max(telemetry.select("timestamp", "service"), ranges, False, {"_last": F.struct("ord", "level")}, width)
    return rows.select("timestamp", "service", F.col("_last").isNotNull().cast("int").alias("incident_label"),
                       F.coalesce(F.col("_last.level"), F.lit("low")).alias("severity_label"))


def before_incidents(telemetry: DataFrame, incidents: DataFrame) -> DataFrame:
    """Rows before the earliest incident start."""
    return telemetry.where(F.col("timestamp") < incidents.agg(F.min("start_time")).scalar())
