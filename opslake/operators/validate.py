"""Data-contract checks that report findings as rows ``(rule, severity, subject, n_bad, message)``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from opslake.functions.scalars import is_infinite, utc_time
from opslake.plans.slicing import over_ordered
from opslake.schema import (
    INCIDENT_TYPES, KEY, NON_NEGATIVE_METRICS, PERCENT_METRICS, REQUIRED_COLUMNS, SERVICES, UNIT_METRICS,
    missing_columns)

FINDINGS = "rule string, severity string, subject string, n_bad bigint, message string"
LATENCY_WARNING_MS = 5000.0
SEQ_BLOCK = 1_000_000


def _finding(rule: str, severity: str, subject, n_bad: Column, text) -> Column:
    as_col = (lambda v: v if isinstance(v, Column) else F.lit(v))
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), as_col(subject).alias("subject"),
                    n_bad.cast("bigint").alias("n_bad"), as_col(text).alias("message"))


def schema_findings(df: DataFrame) -> list[tuple]:
    """Findings that need only the schema: missing columns and the type of ``service``."""
    missing = missing_columns(df.columns)
    if missing:
        return [("required_columns", "error", c, 1, f"missing required column {c}") for c in missing]
    if not isinstance(df.schema["service"].dataType, T.StringType):
        return [("service_type", "error", "service", 1, "service must be text")]
    return []


def _count(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0))


def validate_rules(df: DataFrame, services: tuple[str, ...] = SERVICES) -> DataFrame:
    """All order-free rules. A missing column stops the check, as nothing else can be judged then.

    Nulls, parse failures, bounds and the latency warning come from one aggregation; duplicate keys and unknown services
    from one grouped count each, which combine map-side.
    """
    spark = df.sparkSession
    stops = schema_findings(df)
    if stops:
        found = spark.createDataFrame(stops, FINDINGS)
        if stops[0][0] == "required_columns":
            return found
    is_float = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def is_null(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c) if c in is_float else F.col(c).isNull()

    checks: list[tuple[str, str, str, Column, str]] = [
        ("null_values", "error", c, _count(is_null(c)), f"null values in {c}") for c in df.columns]
    checks.append(("timestamp_format", "error", "timestamp",
                   _count(F.col("timestamp").isNotNull() & utc_time(df, "timestamp").isNull()),
                   "timestamps that cannot be parsed"))
    for m in PERCENT_METRICS:
        checks.append(("bounds", "error", m, _count((F.col(m) < 0) | (F.col(m) > 100)), f"{m} out of bounds [0, 100]"))
    for m in UNIT_METRICS:
        checks.append(("bounds", "error", m, _count(~F.coalesce(F.col(m).between(0.0, 1.0), F.lit(False))),
                       f"{m} out of bounds [0, 1]"))
    for m in NON_NEGATIVE_METRICS:
        checks.append(("negative", "error", m, _count(F.col(m) < 0), f"{m} has negative values"))
    checks.append(("latency_high", "warning", "latency_ms", _count(F.col("latency_ms") > LATENCY_WARNING_MS),
                   "latency above 5000 ms"))
    counted = df.agg(*[c[3].alias(f"_{i}") for i, c in enumerate(checks)])
    one_pass = counted.select(F.inline(F.array(*[
        _finding(rule, severity, subject, F.col(f"_{i}"), text)
        for i, (rule, severity, subject, _, text) in enumerate(checks)])))

    duplicates = (
        df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("_n"))
        .select(F.inline(F.array(_finding("duplicate_key", "error", "timestamp, service", F.col("_n"),
                                          "repeated (timestamp, service)"))))
    )
    unknown = (
        df.where(~F.coalesce(F.col("service").isin(*services), F.lit(False)))
        .groupBy(F.coalesce("service", F.lit("null")).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
        .select(F.inline(F.array(_finding("unknown_service", "error", F.col("_s"), F.col("_n"),
                                          F.concat(F.lit("unknown service "), F.col("_s"))))))
    )
    found_rows = one_pass.unionByName(duplicates).unionByName(unknown)
    if stops:
        found_rows = found_rows.unionByName(found)
    return found_rows.where(F.col("n_bad") > 0)


def validate_order(df: DataFrame, seq: str, mode: str = "auto") -> DataFrame:
    """Services whose timestamps step back when read in ``seq`` order; blocks of ``seq`` keep a busy service spread out."""
    parsed = df.select("service", F.col(seq).alias("_seq"), utc_time(df, "timestamp").alias("_ts"))

    def steps(rows: DataFrame, partition: list[str]) -> DataFrame:
        w = Window.partitionBy(*partition).orderBy("_seq")
        return rows.withColumn("_back", F.lag("_ts").over(w) > F.col("_ts"))

    back = over_ordered(parsed, ["service"], ["_seq"], steps, 1, F.floor(F.col("_seq") / SEQ_BLOCK), mode)
    counted = back.groupBy("service").agg(_count(F.col("_back")).alias("_n")).where(F.col("_n") > 0)
    return counted.select(F.inline(F.array(_finding(
        "timestamp_order", "error", F.col("service"), F.col("_n"),
        F.concat(F.lit("timestamps not in order for "), F.col("service"))))))


def validate_incidents(incidents: DataFrame, telemetry: DataFrame, services: tuple[str, ...] = SERVICES,
                       types: tuple[str, ...] = INCIDENT_TYPES) -> DataFrame:
    """Incident rows that miss keys, name an unknown type or service, are out of order, or miss the telemetry span.

    A missing key hides the later checks of that incident.
    """
    needed = ["incident_id", "incident_type", "root_cause_service", "start_time", "detection_time", "end_time"]
    span = telemetry.agg(F.struct(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))).scalar()
    absent = sum((F.col(c).isNull().cast("int") for c in needed), F.lit(0))
    rows = incidents.withColumn("_span", span).withColumn("_absent", absent)
    whole = F.col("_absent") == 0
    subject = F.concat(F.lit("incident "), F.col("ord").cast("string"))
    start, seen, end = F.col("start_time"), F.col("detection_time"), F.col("end_time")

    def when(rule: str, bad: Column, n: Column, text: str) -> Column:
        return F.when(bad, _finding(rule, "error", subject, n, text))

    one = F.lit(1)
    checks = F.array(
        when("incident_keys", ~whole, F.col("_absent"), "missing incident keys"),
        when("incident_type", whole & ~F.col("incident_type").isin(*types), one, "unrecognized incident type"),
        when("incident_root", whole & ~F.col("root_cause_service").isin(*services), one, "unrecognized root cause service"),
        when("incident_times", whole & ~((start <= seen) & (seen <= end)), one, "incident times out of order"),
        when("incident_span", whole & ((start > F.col("_span.hi")) | (end < F.col("_span.lo"))), one,
             "incident outside the telemetry window"))
    return rows.select(F.inline(F.filter(checks, lambda f: f.isNotNull())))


def passed(findings: DataFrame) -> DataFrame:
    """One row: number of errors and warnings and whether the check passed."""
    return findings.agg(
        _count(F.col("severity") == "error").alias("errors"),
        _count(F.col("severity") == "warning").alias("warnings"),
    ).withColumn("passed", F.col("errors") == 0)


def quality_counts(df: DataFrame, required: tuple[str, ...] = REQUIRED_COLUMNS) -> DataFrame:
    """Rows ``(subject, issue, n)`` for missing columns, nulls (NaN included) and infinities; none means valid."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    parts: list[tuple[str, str, Column]] = []
    for c in df.columns:
        empty = F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()
        parts.append((c, "null", _count(empty)))
        if c in numeric:
            parts.append((c, "infinite", _count(is_infinite(F.col(c)))))
    parts += [(c, "missing_column", F.lit(1)) for c in missing_columns(df.columns, required)]
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[p[2].alias(f"_{i}") for i, p in enumerate(parts)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("subject"), F.lit(issue).alias("issue"), F.col(f"_{i}").cast("bigint").alias("n"))
        for i, (c, issue, _) in enumerate(parts)]))).where(F.col("n") > 0)
