"""Causal time-series features over service histories."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from opslake.plans.scan import affine_scan
from opslake.plans.sizing import settle, use_spread_plan
from opslake.plans.slicing import fitting_time_slice, over_ordered
from opslake.schema import require


@dataclass(frozen=True)
class FeatureConfig:
    windows: tuple[int, ...] = (3, 6, 12)
    steps: tuple[int, ...] = (1, 3)
    metrics: tuple[str, ...] = (
        "cpu_usage_pct", "memory_usage_pct", "latency_ms", "error_rate", "request_rate_rps", "active_connections",
        "connection_utilization")
    cross_service: bool = True
    fill_zeros: bool = True
    epsilon: float = 1e-5

    @property
    def lookback(self) -> int:
        return max(max(self.windows, default=1) - 1, max(self.steps, default=0), 1)


def _fill(c, config: FeatureConfig):
    return F.coalesce(c, F.lit(0.0)) if config.fill_zeros else c


def history_features(telemetry: DataFrame, config: FeatureConfig = FeatureConfig(), mode: str = "auto") -> DataFrame:
    """Rolling mean, deviation and maximum, and deltas and relative changes, all from one sort per partition."""
    metrics = [m for m in config.metrics if m in telemetry.columns]

    def add(df: DataFrame, partition: list[str]) -> DataFrame:
        ordered = Window.partitionBy(*partition).orderBy("timestamp")
        out = []
        for m in metrics:
            x = F.col(m).cast("double")
            for n in config.windows:
                frame = ordered.rowsBetween(1 - n, Window.currentRow)
                out += [F.avg(x).over(frame).alias(f"{m}_roll_mean_{n}"),
                        _fill(F.stddev_pop(x).over(frame), config).alias(f"{m}_roll_std_{n}"),
                        F.max(x).over(frame).alias(f"{m}_roll_max_{n}")]
            for s in config.steps:
                out.append(F.lag(x, s).over(ordered).alias(f"_{m}_before_{s}"))
        rolled = df.select("*", *out)
        changes = []
        for m in metrics:
            for s in config.steps:
                before = F.col(f"_{m}_before_{s}")
                delta = F.col(m) - before
                changes += [_fill(delta, config).alias(f"{m}_delta_{s}"),
                            _fill(delta / (F.abs(before) + F.lit(config.epsilon)), config).alias(f"{m}_pct_change_{s}")]
        return rolled.select("*", *changes).drop(*[f"_{m}_before_{s}" for m in metrics for s in config.steps])

    return over_ordered(telemetry, ["service"], ["timestamp"], add, config.lookback,
                        fitting_time_slice("timestamp", ["service"]), mode)


def interaction_features(telemetry: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    eps = F.lit(config.epsilon)
    return telemetry.select(
        "*",
        (F.col("latency_ms") * F.col("error_rate")).alias("latency_error_product"),
        (F.col("error_rate") / (F.col("request_rate_rps") + eps)).alias("error_per_request"),
        (F.col("connection_utilization") * F.col("active_connections")).alias("connection_pressure"),
        (F.col("network_in_mbps") / (F.col("network_out_mbps") + eps)).alias("traffic_ratio_in_out"))


def cross_service_features(telemetry: DataFrame, config: FeatureConfig = FeatureConfig(), mode: str = "auto") -> DataFrame:
    """System-wide statistics per timestamp, sent back to each row.

    Grouping first keeps the exchange to one small row per timestamp. On large inputs that table is written, so that Spark
    knows its size when it plans the join and moves the wide rows only if it is too big to broadcast.
    """
    per_time = telemetry.groupBy("timestamp").agg(
        F.avg("latency_ms").alias("system_mean_latency"),
        F.max("error_rate").alias("system_max_error_rate"),
        F.avg("cpu_usage_pct").alias("system_mean_cpu"))
    if use_spread_plan(telemetry, mode):
        per_time = settle(per_time, "per_time")
    joined = telemetry.join(per_time, "timestamp", "left")
    return joined.withColumn("latency_to_system_mean_ratio",
                             F.col("latency_ms") / (F.col("system_mean_latency") + F.lit(config.epsilon)))


def ewma_features(telemetry: DataFrame, metrics: tuple[str, ...] = ("latency_ms", "error_rate"), alpha: float = 0.3, mode: str = "auto") -> DataFrame:
    """Exponentially weighted mean of each metric over the whole history of its service, as ``<metric>_ewma``.

    A value k observations back weighs (1 - alpha)^k, weights are divided by their sum, and missing values count as no
    observation; before the first one the mean is null. Exact for histories of any length.
    """
    maps = {}
    for m in metrics:
        seen = F.col(m).isNotNull()
        keep = F.when(seen, F.lit(1.0 - alpha)).otherwise(F.lit(1.0))
        maps |= {f"_{m}_sum": (keep, F.coalesce(F.col(m).cast("double"), F.lit(0.0))), f"_{m}_weight": (keep, F.when(seen, 1.0).otherwise(0.0))}
    scanned = affine_scan(telemetry, ["service"], ["timestamp"], maps, mode)
    return scanned.select(*telemetry.columns, *[
        F.when(F.col(f"_{m}_weight") > 0, F.col(f"_{m}_sum") / F.col(f"_{m}_weight")).alias(f"{m}_ewma") for m in metrics])


def extract_features(telemetry: DataFrame, config: FeatureConfig = FeatureConfig(), mode: str = "auto") -> DataFrame:
    """Telemetry plus all features: narrow steps first, so the join carries few columns into the windows."""
    require(telemetry)
    rows = interaction_features(telemetry, config)
    if config.cross_service:
        rows = cross_service_features(rows, config, mode)
    return history_features(rows, config, mode)
