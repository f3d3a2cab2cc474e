"""Trailing z-score anomaly detector."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from opslake.functions.scalars import greatest_of
from opslake.plans.slicing import fitting_time_slice, over_ordered


@dataclass(frozen=True)
class ZScoreConfig:
    window: int = 30
    threshold: float = 3.0
    min_history: int = 5
    metrics: tuple[str, ...] = (
        "latency_ms", "error_rate", "cpu_usage_pct", "connection_utilization", "active_connections")
    epsilon: float = 1e-4


def zscore_frame(telemetry: DataFrame, config: ZScoreConfig = ZScoreConfig(), mode: str = "auto",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Key columns, the columns to ``keep``, and per metric the mean and deviation of the rows before it and the absolute
    z-score.
    """
    metrics = [m for m in config.metrics if m in telemetry.columns]
    columns = list(dict.fromkeys(["timestamp", "service", *metrics, *keep]))

    def score(df: DataFrame, partition: list[str]) -> DataFrame:
        past = Window.partitionBy(*partition).orderBy("timestamp").rowsBetween(-config.window, -1)
        enough = {m: F.count(m).over(past) >= config.min_history for m in metrics}
        stats = df.select(
            "*",
            *[F.when(enough[m], F.avg(m).over(past)).alias(f"{m}_base_mean") for m in metrics],
            *[F.when(enough[m], F.stddev_pop(m).over(past)).alias(f"{m}_base_std") for m in metrics])
        return stats.select("*", *[
            F.coalesce(
                F.abs(F.col(m) - F.col(f"{m}_base_mean"))
                / (F.coalesce(F.col(f"{m}_base_std"), F.lit(0.0)) + F.lit(config.epsilon)),
                F.lit(0.0)).alias(f"{m}_z")
            for m in metrics])

    return over_ordered(telemetry.select(*columns), ["service"], ["timestamp"], score, config.window,
                        fitting_time_slice("timestamp", ["service"]), mode)


def zscore_anomalies(telemetry: DataFrame, config: ZScoreConfig = ZScoreConfig(), mode: str = "auto",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """``timestamp, service``, the columns to ``keep``, ``anomaly_score, is_anomaly, anomalous_metrics``.

    With ``keep`` the telemetry is flagged in place, which saves joining the findings back to it.

    The score is the largest z-score rounded to 4 places and the flag uses the rounded score; the metric list uses the
    unrounded z-scores.
    """
    metrics = [m for m in config.metrics if m in telemetry.columns]
    if not metrics:
        return telemetry.select("timestamp", "service", *keep, F.lit(0.0).alias("anomaly_score"),
                                F.lit(False).alias("is_anomaly"), F.lit("").alias("anomalous_metrics"))
    return flagged(zscore_frame(telemetry, config, mode, keep), metrics, config, keep)


def flagged(z: DataFrame, metrics: list[str], config: ZScoreConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score, flag and metric list of rows that have ``<metric>_z`` for every metric."""
    score = F.round(greatest_of([F.col(f"{m}_z") for m in metrics]), 4)
    listed = F.concat_ws(",", *[F.when(F.col(f"{m}_z") >= config.threshold, F.lit(m)) for m in metrics])
    return z.select("timestamp", "service", *keep, score.alias("anomaly_score"),
                    (score >= config.threshold).alias("is_anomaly"), listed.alias("anomalous_metrics"))
