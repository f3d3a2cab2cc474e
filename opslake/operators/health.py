"""Model health: prediction distribution and the verdict over quality, latency and drift."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opslake.operators.drift import DriftConfig, drift_report, feature_drift
from opslake.operators.validate import quality_counts
from opslake.plans.ordering import quantiles
from opslake.schema import REQUIRED_COLUMNS

# Columns that may hold the positive flag and the score of a prediction table, in order of preference.
FLAGS = (("is_anomaly", "anomaly_score"), ("is_predicted_incident", "incident_probability"),
         ("is_incident_predicted", "incident_probability"))


def _flag_and_score(df: DataFrame) -> tuple[Column, Column]:
    for flag, score in FLAGS:
        if flag in df.columns:
            value = F.col(score).cast("double") if score in df.columns else F.col(flag).cast("int").cast("double")
            return F.col(flag), value
    if "score" in df.columns:
        return F.col("score") > 0.5, F.col("score").cast("double")
    return F.lit(False), F.lit(0.0)


def prediction_distribution(predictions: DataFrame, mode: str = "auto") -> DataFrame:
    """One row: predictions, positives and their rate, and mean, range and percentiles of the score."""
    flag, score = _flag_and_score(predictions)
    rows = predictions.select(flag.alias("_flag"), score.alias("_score"))
    basic = rows.agg(
        F.count(F.lit(1)).alias("total_predictions"), F.coalesce(F.count_if("_flag"), F.lit(0)).alias("positive_predictions"),
        F.avg("_score").alias("_mean"), F.min("_score").alias("_min"), F.max("_score").alias("_max"))
    cuts = quantiles(rows, [], "_score", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, mode).select(F.struct("*")).scalar()
    n = F.col("total_predictions")

    def shown(c: Column) -> Column:
        return F.coalesce(F.round(c, 4), F.lit(0.0))

    return basic.withColumn("_q", cuts).select(
        "total_predictions", "positive_predictions",
        F.when(n > 0, F.round(F.col("positive_predictions") / n, 4)).otherwise(F.lit(0.0)).alias("positive_rate"),
        shown(F.col("_mean")).alias("score_mean"), shown(F.col("_min")).alias("score_min"),
        shown(F.col("_max")).alias("score_max"),
        *[shown(F.col(f"_q.{q}")).alias(f"score_{q}") for q in ("p50", "p90", "p99")])


def model_health(current: DataFrame, reference: DataFrame | None, latency_ms: float, sla_ms: float = 500.0,
                 model_name: str = "isolation_forest", model_version: str = "1.0.0",
                 required: tuple[str, ...] = REQUIRED_COLUMNS, config: DriftConfig = DriftConfig(),
                 mode: str = "auto") -> DataFrame:
    """One row with NORMAL, WARNING or CRITICAL and the reasons; the latency is a measured number handed in."""
    issues = quality_counts(current, required).agg(F.count(F.lit(1)).alias("quality_issues"))
    row = issues
    if reference is not None:
        report = drift_report(feature_drift(reference, current, None, config, mode), reference, current)
        row = row.withColumn("_d", report.select(F.struct(
            F.size("drifted_features").alias("drifted"), F.size("warning_features").alias("warned"), "drift_share")).scalar())
        share, drifted, warned = F.col("_d.drift_share"), F.col("_d.drifted"), F.col("_d.warned")
    else:
        share, drifted, warned = F.lit(0.0), F.lit(0), F.lit(0)
    bad_quality = F.col("quality_issues") > 0
    critical_drift, any_drift = share >= 0.3, (drifted > 0) | (warned > 0)
    latency, sla = F.lit(float(latency_ms)), F.lit(float(sla_ms))
    level = F.greatest(
        F.when(bad_quality, 2).otherwise(0),
        F.when(latency > sla * 2, 2).when(latency > sla, 1).otherwise(0),
        F.when(critical_drift, 2).when(any_drift, 1).otherwise(0))
    # The sentences.
    reasons = F.array_compact(F.array(
        F.when(bad_quality, F.concat(F.lit("Data quality check failed with "), F.col("quality_issues").cast("string"),
                                     F.lit(" issue(s)."))),
        F.when(latency > sla * 2, F.concat(F.lit("Inference latency ("), latency.cast("string"),
                                           F.lit("ms) breached 2x SLA limit ("), sla.cast("string"), F.lit("ms).")))
        .when(latency > sla, F.concat(F.lit("Inference latency ("), latency.cast("string"), F.lit("ms) exceeded SLA ("),
                                      sla.cast("string"), F.lit("ms)."))),
        F.when(critical_drift, F.concat(F.lit("Critical drift: "), drifted.cast("string"), F.lit(" features drifted ("),
                                        F.round(share * 100, 1).cast("string"), F.lit("%).")))
        .when(any_drift, F.concat(F.lit("Drift alert: "), drifted.cast("string"), F.lit(" drifted, "),
                                  warned.cast("string"), F.lit(" warning features.")))))
    fine = F.array(F.lit("All operational, data quality, and drift checks healthy."))
    return row.select(
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
        F.element_at(F.array(F.lit("NORMAL"), F.lit("WARNING"), F.lit("CRITICAL")), level + 1).alias("health_status"),
        "quality_issues", drifted.cast("bigint").alias("drifted_features"), warned.cast("bigint").alias("warning_features"),
        share.alias("drift_share"), F.when(F.size(reasons) == 0, fine).otherwise(reasons).alias("status_reasons"))
