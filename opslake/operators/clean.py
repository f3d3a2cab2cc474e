"""Telemetry cleaning with an account of what was dropped and why."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from opslake.functions.scalars import nan_to_null, utc_time
from opslake.schema import (
    KEY, METRICS, NON_NEGATIVE_METRICS, PERCENT_METRICS, REQUIRED_COLUMNS, SERVICES, UNIT_METRICS, require)


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def in_bounds() -> Column:
    """All ten metric bounds, with both ends included."""
    checks = [F.col(m).between(0.0, 100.0) for m in PERCENT_METRICS]
    checks += [F.col(m).between(0.0, 1.0) for m in UNIT_METRICS]
    checks += [F.col(m) >= 0 for m in NON_NEGATIVE_METRICS]
    return reduce(lambda a, b: a & b, checks)


def _first_copies(raw: DataFrame, seq: str, services: tuple[str, ...]) -> DataFrame:
    """One row per (fate, key): number of rows and, for keys that got that far, the earliest copy.

    Rows that fail an earlier step share one key per fate, and copies of a hot key collapse map-side, so one aggregation
    serves both the clean table and the drop account whatever the skew.
    """
    df = normalize_headers(raw)
    require(df)
    known = F.col("service").isin(*services)
    typed = df.select(
        F.col(seq).alias("_seq"),
        F.lower(F.trim(F.coalesce(F.col("service").cast("string"), F.lit("nan")))).alias("service"),
        utc_time(df, "timestamp").alias("timestamp"),
        *[nan_to_null(F.col(m).cast("double")).alias(m) for m in METRICS])
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED_COLUMNS])
    fated = typed.withColumn("fate", F.when(~known, "unknown_service").when(absent, "null").otherwise("kept"))
    kept = F.col("fate") == "kept"
    return (
        fated.groupBy("fate", F.when(kept, F.col("timestamp")).alias("timestamp"),
                      F.when(kept, F.col("service")).alias("service"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.when(kept, F.struct("_seq", *METRICS))).alias("first"))
        .select("fate", "timestamp", "service", "copies", *[F.col(f"first.{m}").alias(m) for m in METRICS])
    )


def clean_telemetry(raw: DataFrame, seq: str, services: tuple[str, ...] = SERVICES) -> DataFrame:
    """Known services, parsed times, no nulls, first copy of each key by ``seq``, values in bounds.

    The first copy is chosen before bounds are checked, so a key whose first copy is out of bounds is lost.
    """
    rows = _first_copies(raw, seq, services).where((F.col("fate") == "kept") & in_bounds())
    return rows.select(*KEY, *[F.col(m).cast("bigint").alias(m) if m == "active_connections" else F.col(m)
                               for m in METRICS])


def clean_report(raw: DataFrame, seq: str, services: tuple[str, ...] = SERVICES) -> DataFrame:
    """One row with the rows read, the rows kept and one counter per cleaning step."""
    groups = _first_copies(raw, seq, services)
    kept = F.col("fate") == "kept"

    def total(cond: Column, value: Column = F.col("copies")) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("bigint")

    one = F.lit(1)
    return groups.agg(
        total(F.lit(True)).alias("input_rows"),
        total(kept & in_bounds(), one).alias("output_rows"),
        total(F.col("fate") == "unknown_service").alias("unknown_service_rows_dropped"),
        total(F.col("fate") == "null").alias("null_rows_dropped"),
        total(kept, F.col("copies") - 1).alias("duplicate_rows_dropped"),
        total(kept & ~in_bounds(), one).alias("invalid_rows_dropped"),
    ).withColumn("total_dropped", F.col("input_rows") - F.col("output_rows"))


def first_copies(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Keep the first row per key by ``seq``, collapsing copies map-side."""
    rest = [c for c in df.columns if c not in keys and c != seq]
    packed = df.groupBy(*keys).agg(F.min(F.struct(seq, *rest)).alias("_first"))
    return packed.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [seq, *rest]]).select(*df.columns)
