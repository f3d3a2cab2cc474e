"""Composed evaluations: detector comparison and the incident prediction and severity run."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from opslake.operators.features import extract_features
from opslake.operators.iforest import ForestConfig, detect_with_forest
from opslake.operators.labels import horizon_labels, incident_labels, severity_labels
from opslake.operators.linear import LinearModel
from opslake.operators.metrics import (
    anomaly_metrics, binary_metrics, detection_delays, lead_times, mean_detection_delay, ranking_quality, severity_metrics)
from opslake.operators.predictor import PredictorConfig, fit_predictor, incident_probability
from opslake.operators.prep import chronological_split, positional_split
from opslake.operators.severity import fit_severity, predict_severity
from opslake.operators.zscore import ZScoreConfig, zscore_anomalies
from opslake.plans.sizing import settle


def detector_benchmark(telemetry: DataFrame, incidents: DataFrame, zscore: ZScoreConfig = ZScoreConfig(),
                       forest: ForestConfig = ForestConfig(), train: DataFrame | None = None,
                       mode: str = "auto") -> DataFrame:
    """One row per detector: confusion counts, rates and mean detection delay on the same labels."""
    telemetry = settle(telemetry, "telemetry")
    labels = incident_labels(telemetry, incidents)
    found = {
        "statistical_baseline": zscore_anomalies(telemetry, zscore, mode),
        "isolation_forest": detect_with_forest(telemetry, forest, train, incidents, mode),
    }
    rows = None
    for name, flagged in found.items():
        flagged = settle(flagged, "flagged")
        delay = mean_detection_delay(detection_delays(flagged, incidents)).select("detection_delay_seconds").scalar()
        one = anomaly_metrics(flagged, labels).withColumn("detector", F.lit(name)).withColumn(
            "detection_delay_seconds", delay)
        rows = one if rows is None else rows.unionByName(one)
    return rows


@dataclass
class IncidentEvaluation:
    prediction: DataFrame
    lead_time: DataFrame
    severity: DataFrame
    predictor: LinearModel
    severity_model: LinearModel | None


def evaluate_incidents(telemetry: DataFrame, incidents: DataFrame, config: PredictorConfig = PredictorConfig(),
                       validation: float = 0.15, test: float = 0.15, mode: str = "auto") -> IncidentEvaluation:
    """Features, horizon labels, split, fit and metrics on each split; lead time over all rows; then severity.

    ``telemetry`` is clean. The feature table is written once and shared by the fit and every evaluation.
    """
    feats = settle(extract_features(telemetry, mode=mode), "features")
    keys = ["timestamp", "service"]
    labelled = feats.join(horizon_labels(feats, incidents, config.horizon_seconds, config.service_specific,
                                         config.lead_time_only), keys)
    train_share = max(0.0, 1.0 - (validation + test))
    split = settle(chronological_split(labelled, train_share, validation, test, mode), "labelled")
    model = fit_predictor(split.where("split = 'train'"), config=config, mode=mode)
    scored = incident_probability(split, model).select(
        *keys, "split", F.col("is_incident_in_horizon").alias("truth"), F.col("_probability").alias("p"),
        (F.col("_probability") >= config.threshold).alias("is_predicted_incident"))
    prediction = binary_metrics(scored, "truth", "is_predicted_incident", ("split",)).join(
        ranking_quality(scored, "truth", "p", ("split",), mode), "split")
    lead = lead_times(scored, incidents, config.horizon_seconds).agg(F.avg("lead_seconds").alias("lead_time_seconds"))

    levels = feats.join(severity_labels(feats, incidents).where(F.col("severity").isNotNull()), keys)
    empty = severity_metrics(feats.select(F.lit("").alias("severity"), F.lit("").alias("predicted_severity")).limit(0))
    if levels.isEmpty():
        return IncidentEvaluation(prediction, lead, empty, model, None)
    parts = settle(positional_split(levels, test, mode), "severity")
    sev_model = fit_severity(parts.where("split = 'train'"), mode=mode)
    held = parts.where("split = 'test'")
    judged = predict_severity(parts.where("split = 'train'") if held.isEmpty() else held, sev_model, ("severity",))
    return IncidentEvaluation(prediction, lead, severity_metrics(judged, labels=tuple(sev_model.classes)), model, sev_model)


def zscore_score_quality(flagged: DataFrame, labels: DataFrame, mode: str = "auto") -> DataFrame:
    """ROC-AUC and average precision of a detector's score against incident labels."""
    both = flagged.select("timestamp", "service", "anomaly_score").join(
        labels.select("timestamp", "service", "is_incident"), ["timestamp", "service"])
    return ranking_quality(both, "is_incident", "anomaly_score", (), mode)
