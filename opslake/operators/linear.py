"""Balanced, L2-regularised logistic regression on MLlib: incident predictor and severity classifier."""
from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslake.operators.prep import scale, scaler_stats
from opslake.plans.sizing import settle
from opslake.schema import numeric_columns

ROWS_PER_TASK = 50_000
NOT_FEATURES = (
    "timestamp", "service", "is_incident", "is_root_cause", "incident_id", "incident_type", "is_incident_in_horizon",
    "severity", "description", "start_time", "detection_time", "end_time", "split",
)


@dataclass(frozen=True)
class LinearConfig:
    balanced: bool = True
    c: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-6
    features: tuple[str, ...] | None = None


@dataclass
class LinearModel:
    """Fitted state. ``coefficients`` has one row per class (one row in all for two classes)."""
    classes: list[str]
    features: list[str]
    stats: list[dict]
    coefficients: list[list[float]]
    intercepts: list[float]
    model: LogisticRegressionModel | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        state = {k: v for k, v in asdict(self).items() if k != "model"} if self.model is None else {
            "classes": self.classes, "features": self.features, "stats": self.stats,
            "coefficients": self.coefficients, "intercepts": self.intercepts}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/state")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/mllib")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        fitted = len(state["classes"]) > 1 and any(any(r) for r in state["coefficients"])
        return cls(**state, model=LogisticRegressionModel.load(f"{path}/mllib") if fitted else None)


def _vectors(df: DataFrame, features: list[str], stats: list[dict]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x").transform(scale(df, stats))


def fit_linear(train: DataFrame, label: str, config: LinearConfig = LinearConfig(), mode: str = "auto") -> LinearModel:
    """Fit on ``train``; classes are the distinct labels in text order.

    Class weights n / (k * n_c) sum to n, so a strength C maps to regParam = 1 / (C * n). The label counts and scaler
    rows that come to the driver number one per class and one per feature.
    """
    train = settle(train, "train")
    features = [c for c in config.features if c in train.columns] if config.features else numeric_columns(
        train, (*NOT_FEATURES, label))
    if not features:
        raise ValueError("no numeric feature columns")
    counts = {r["_y"]: r["n"] for r in
              train.groupBy(F.col(label).cast("string").alias("_y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("no training rows")
    stats = [r.asDict() for r in scaler_stats(train, features, mode).collect()]
    classes = sorted(counts)
    if len(classes) < 2:
        return LinearModel(classes, features, stats, [[0.0] * len(features)], [0.0])

    n, k = sum(counts.values()), len(classes)
    index, weight = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, c in enumerate(classes):
        same = F.col(label).cast("string") == c
        index = F.when(same, F.lit(float(i))).otherwise(index)
        weight = F.when(same, F.lit(n / (k * counts[c]) if config.balanced else 1.0)).otherwise(weight)
    # Every iteration is one pass over these rows, so small inputs get few tasks.
    rows = (
        _vectors(train, features, stats).select("_x", index.alias("_label"), weight.alias("_weight"))
        .coalesce(max(1, math.ceil(n / ROWS_PER_TASK))).persist()
    )
    try:
        model = LogisticRegression(
            featuresCol="_x", labelCol="_label", weightCol="_weight", family="binomial" if k == 2 else "multinomial",
            regParam=1.0 / (config.c * n), elasticNetParam=0.0, standardization=False, maxIter=config.max_iter,
            tol=config.tol, rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_class").fit(rows)
    finally:
        rows.unpersist()
    matrix = model.coefficientMatrix.toArray().tolist()
    return LinearModel(classes, features, stats, matrix, [float(v) for v in model.interceptVector], model)


def class_probabilities(df: DataFrame, model: LinearModel) -> DataFrame:
    """``df`` plus the array ``_p`` of class probabilities in class order."""
    if model.model is None:
        return df.withColumn("_p", F.array(F.lit(1.0)))
    keep = [c for c in df.columns if c not in model.features]
    packed = df.select(*keep, *model.features, F.struct(*model.features).alias("_kept"))
    scored = model.model.transform(_vectors(packed, model.features, model.stats))
    return scored.select(*keep, *[F.col(f"_kept.{c}").alias(c) for c in model.features],
                         vector_to_array("_p").alias("_p")).select(*df.columns, "_p")


def optimality(df: DataFrame, label: str, model: LinearModel, config: LinearConfig = LinearConfig()) -> DataFrame:
    """``class, feature, coefficient, gradient`` of the penalised loss at the model, over its training rows; the intercept's feature is null.

    Probabilities are computed anew from the coefficients, and all sums are one distributed aggregate. The loss is
    strongly convex in the coefficients with constant 1 / (C n), so their distance from the optimum is at most C n times the norm of
    the gradient: a model whose gradients vanish is the optimum, whatever found it. A model of one class has no coefficients to
    find and gives gradients of 0.
    """
    spark = df.sparkSession
    schema = "class string, feature string, coefficient double, gradient double"
    names = [*model.features, None]
    if model.model is None:
        return spark.createDataFrame([(model.classes[0], f, 0.0, 0.0) for f in names], schema)
    given = F.col(label).cast("string")
    counts = {r["_y"]: r["n"] for r in df.groupBy(given.alias("_y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, k = sum(counts.values()), len(model.classes)
    weight = F.create_map(*[v for c in model.classes for v in (F.lit(c), F.lit(n / (k * counts[c]) if config.balanced else 1.0))])
    binary = len(model.coefficients) == 1 and k == 2
    shown = [model.classes[1]] if binary else model.classes
    margins = [sum((F.lit(b) * F.col(f) for f, b in zip(model.features, row, strict=True)), F.lit(a))
               for row, a in zip(model.coefficients, model.intercepts, strict=True)]
    scaled = scale(df, model.stats).select(*model.features, given.alias("_y"), weight[given].alias("_w"), *[m.alias(f"_m{i}") for i, m in enumerate(margins)])
    if binary:
        chances = [F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_m0")))]
    else:
        top = F.greatest(*[F.col(f"_m{i}") for i in range(k)])
        parts = [F.exp(F.col(f"_m{i}") - top) for i in range(k)]
        chances = [p / sum(parts[1:], parts[0]) for p in parts]
    off = scaled.select("*", *[(F.col("_w") * (p - (F.col("_y") == c).cast("double"))).alias(f"_o{i}") for i, (c, p) in enumerate(zip(shown, chances, strict=True))])
    sums = off.agg(F.sum("_w").alias("w"), *[F.sum(F.col(f"_o{i}") * (F.col(f) if f else F.lit(1.0))).alias(f"g{i}_{j}")
                                             for i in range(len(shown)) for j, f in enumerate(names)])
    entries = [F.struct(F.lit(c).alias("class"), F.lit(f).cast("string").alias("feature"), F.lit(model.coefficients[i][j] if f else model.intercepts[i]).alias("coefficient"),
                        (F.col(f"g{i}_{j}") / F.col("w") + F.lit(model.coefficients[i][j] / (config.c * n) if f else 0.0)).alias("gradient"))
               for i, c in enumerate(shown) for j, f in enumerate(names)]
    return sums.select(F.inline(F.array(*entries)))
