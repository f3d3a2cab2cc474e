"""Incident predictor: probability that an incident is active or starts within the horizon."""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslake.operators.linear import LinearConfig, LinearModel, class_probabilities, fit_linear

# Fixed value: log-odds used when the training slice has one class only.
ONE_CLASS_LOG_ODDS = 10.0


@dataclass(frozen=True)
class PredictorConfig:
    horizon_seconds: float = 1800.0
    service_specific: bool = True
    lead_time_only: bool = False
    threshold: float = 0.5
    linear: LinearConfig = field(default_factory=LinearConfig)


def fit_predictor(train: DataFrame, label: str = "is_incident_in_horizon", config: PredictorConfig = PredictorConfig(),
                  mode: str = "auto") -> LinearModel:
    return fit_linear(train.withColumn(label, F.col(label).cast("int")), label, config.linear, mode)


def incident_probability(df: DataFrame, model: LinearModel) -> DataFrame:
    """``df`` plus the unrounded ``_probability`` of the positive class."""
    if model.model is None:
        odds = ONE_CLASS_LOG_ODDS if model.classes == ["1"] else -ONE_CLASS_LOG_ODDS
        return df.withColumn("_probability", F.lit(1.0 / (1.0 + math.exp(-odds))))
    return class_probabilities(df, model).withColumn("_probability", F.col("_p")[1]).drop("_p")


def predict_incidents(df: DataFrame, model: LinearModel, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """``timestamp, service, incident_probability`` (4 places) and ``is_predicted_incident`` from the unrounded value."""
    p = F.col("_probability")
    return incident_probability(df, model).select(
        "timestamp", "service", *keep, F.round(p, 4).alias("incident_probability"),
        (p >= threshold).alias("is_predicted_incident"))


def top_features(spark: SparkSession, model: LinearModel, n: int = 10) -> DataFrame:
    """The n features with the largest absolute coefficient; one input row per feature."""
    rows = [(f, float(c)) for f, c in zip(model.features, model.coefficients[0])]
    return (
        spark.createDataFrame(rows, "feature string, coefficient double")
        .orderBy(F.desc(F.abs("coefficient")), "feature").limit(n)
    )
