"""Column names, fixed domains and Spark types of the telemetry and incident tables.

Timestamps are UTC wall-clock values (``TIMESTAMP_NTZ``) on the batch path.
"""
from __future__ import annotations

from pyspark.sql import types as T

# Service domain, incident types, telemetry columns.
SERVICES = ("api_gateway", "auth_service", "orders_service", "database")
INCIDENT_TYPES = ("database_connection_saturation",)
SEVERITIES = ("low", "medium", "high", "critical")
PERCENT_METRICS = ("cpu_usage_pct", "memory_usage_pct", "disk_usage_pct")
UNIT_METRICS = ("error_rate", "connection_utilization")
NON_NEGATIVE_METRICS = ("network_in_mbps", "network_out_mbps", "request_rate_rps", "latency_ms", "active_connections")
METRICS = (
    "cpu_usage_pct", "memory_usage_pct", "disk_usage_pct", "network_in_mbps", "network_out_mbps",
    "request_rate_rps", "latency_ms", "error_rate", "active_connections", "connection_utilization",
)
KEY = ("timestamp", "service")
REQUIRED_COLUMNS = KEY + METRICS

TELEMETRY = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType()), T.StructField("service", T.StringType())]
    + [T.StructField(m, T.LongType() if m == "active_connections" else T.DoubleType()) for m in METRICS]
)

# Fields of incident documents and of experiment runs.
INCIDENT = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("incident_type", T.StringType()),
    T.StructField("root_cause_service", T.StringType()),
    T.StructField("affected_services", T.ArrayType(T.StringType())),
    T.StructField("start_time", T.StringType()),
    T.StructField("detection_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
])

RUN = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("training_config", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("model_version", T.StringType()),
    T.StructField("feature_version", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("random_seed", T.LongType()),
    T.StructField("artifact_path", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("training_timestamp", T.StringType()),
])


def missing_columns(columns, required=REQUIRED_COLUMNS) -> list[str]:
    return [c for c in required if c not in columns]


def require(df, required=REQUIRED_COLUMNS) -> None:
    missing = missing_columns(df.columns, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def numeric_columns(df, exclude=()) -> list[str]:
    """Sorted names of numeric or boolean columns not excluded."""
    return sorted(
        f.name for f in df.schema.fields
        if f.name not in exclude and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    )
