"""Severity classifier: multinomial model over the severities found in training."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslake.operators.linear import LinearConfig, LinearModel, class_probabilities, fit_linear


def fit_severity(train: DataFrame, label: str = "severity", config: LinearConfig = LinearConfig(),
                 mode: str = "auto") -> LinearModel:
    return fit_linear(train, label, config, mode)


def predict_severity(df: DataFrame, model: LinearModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """``timestamp, service, predicted_severity`` and one ``prob_<class>`` per trained class, to 4 places."""
    scored = class_probabilities(df, model)
    classes = F.array(*[F.lit(c) for c in model.classes])
    best = classes[F.array_position("_p", F.array_max("_p")).cast("int") - 1]
    return scored.select(
        "timestamp", "service", *keep, best.alias("predicted_severity"),
        *[F.round(F.col("_p")[i], 4).alias(f"prob_{c}") for i, c in enumerate(model.classes)])
