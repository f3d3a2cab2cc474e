import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from opslake.operators.evaluate import evaluate_incidents
from opslake.operators.linear import LinearConfig, LinearModel, class_probabilities, fit_linear
from opslake.operators.predictor import PredictorConfig, fit_predictor, predict_incidents, top_features
from opslake.operators.severity import fit_severity, predict_severity


@pytest.fixture(scope="module")
def labelled(telemetry):
    rnd = random.Random(11)
    rows = [(i * 60, "database", {"latency_ms": rnd.gauss(20 + 15 * (i % 4 == 0), 8), "cpu_usage_pct": rnd.gauss(30, 5),
                                  "memory_usage_pct": None if i % 9 == 0 else rnd.gauss(40, 3)}) for i in range(160)]
    t = telemetry(rows)
    return t.withColumn("is_incident_in_horizon", F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / 60) % 4 == 0)


def _newton(x, y, w, c=1.0):
    """Minimiser of |b|^2 / 2 + c * sum w * logloss with a free intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(a.shape[1])
    ridge = np.eye(len(b))
    ridge[-1, -1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        b -= np.linalg.solve(ridge + c * (a.T * (w * p * (1 - p))) @ a, ridge @ b + c * a.T @ (w * (p - y)))
    return b


def test_binary_fit_is_the_penalised_optimum(labelled):
    feats = ("latency_ms", "cpu_usage_pct", "memory_usage_pct")
    m = fit_predictor(labelled, config=PredictorConfig(linear=LinearConfig(features=feats, tol=1e-12)))
    pdf = labelled.toPandas()
    x = pdf[list(feats)].astype(float)
    x = x.fillna(x.median())
    x = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    y = pdf["is_incident_in_horizon"].to_numpy(dtype=float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    assert np.allclose([*m.coefficients[0], m.intercepts[0]], _newton(x, y, w), atol=1e-4)


def test_predictions_flags_and_persistence(labelled, spark, tmp_path):
    m = fit_predictor(labelled)
    assert "is_incident_in_horizon" not in m.features and m.features == sorted(m.features)
    got = rows_of(predict_incidents(labelled, m), "timestamp")
    assert all(0 <= g[2] <= 1 for g in got) and sum(g[3] for g in got) > 30
    m.save(spark, str(tmp_path / "m"))
    assert rows_of(predict_incidents(labelled, LinearModel.load(spark, str(tmp_path / "m"))), "timestamp") == got
    top = top_features(spark, m, 3).collect()
    assert top[0].feature == "latency_ms" and len(top) == 3


def test_one_class(labelled, spark, tmp_path):
    for value, sign in ((True, 1), (False, -1)):
        m = fit_predictor(labelled.withColumn("is_incident_in_horizon", F.lit(value)))
        r = predict_incidents(labelled, m).first()
        assert r.incident_probability == round(1 / (1 + math.exp(-10 * sign)), 4) and r.is_predicted_incident is value
    only = fit_severity(labelled.withColumn("severity", F.lit("high")))
    only.save(spark, str(tmp_path / "one"))
    r = predict_severity(labelled, LinearModel.load(spark, str(tmp_path / "one"))).first()
    assert (r.predicted_severity, r.prob_high) == ("high", 1.0)
    with pytest.raises(ValueError):
        fit_predictor(labelled.limit(0))
    with pytest.raises(ValueError):
        fit_linear(labelled.select("timestamp", "is_incident_in_horizon"), "is_incident_in_horizon")


def test_three_severities(labelled):
    level = F.when(F.col("latency_ms") > 30, "critical").when(F.col("latency_ms") > 18, "low").otherwise("medium")
    rows = labelled.drop("is_incident_in_horizon").withColumn("severity", level)
    m = fit_severity(rows)
    assert m.classes == ["critical", "low", "medium"]
    out = predict_severity(rows, m, ("severity",))
    assert out.columns[-3:] == ["prob_critical", "prob_low", "prob_medium"]
    assert out.where("severity = predicted_severity").count() > 0.8 * out.count()
    assert class_probabilities(rows, m).where(F.abs(F.aggregate("_p", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0


def test_full_evaluation(telemetry, incidents):
    rnd = random.Random(5)
    t = telemetry([(i * 60, s, {"latency_ms": rnd.gauss(20, 3) + (300 if 100 <= i % 150 < 120 else 0)})
                   for i in range(300) for s in ("database", "api_gateway")])
    inc = incidents(*[{"id": f"I{k}", "root": "database", "affected": ["database", "api_gateway"], "start": (100 + 150 * k) * 60,
                       "end": (119 + 150 * k) * 60, "severity": "critical"} for k in (0, 1)])
    done = evaluate_incidents(t, inc, PredictorConfig(horizon_seconds=300, linear=LinearConfig(max_iter=60)), 0.2, 0.2)
    splits = {r.split: r for r in done.prediction.collect()}
    assert set(splits) == {"train", "validation", "test"} and splits["train"].f1_score > 0.8
    assert {r.macro_f1 for r in done.severity.collect()} == {1.0} and done.severity_model.classes == ["critical"]
    assert done.lead_time.count() == 1


@pytest.mark.parametrize("classes", [2, 3, 1])
def test_gradients_vanish_at_the_fit_and_nowhere_else(spark, classes):
    import random

    from opslake.operators.linear import LinearConfig, fit_linear, optimality

    rng = random.Random(6)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1), 0) for _ in range(300)]
    rows = [(a, b if i % 40 else None, "abc"[(a + 0.3 * rng.gauss(0, 1) > 0) + (classes > 2 and b > 0.5)] if classes > 1 else "a") for i, (a, b, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "u double, v double, y string")
    config = LinearConfig(tol=1e-10)
    model = fit_linear(df, "y", config)
    found = optimality(df, "y", model, config).collect()
    assert len(found) == 3 * (1 if classes < 3 else 3) and max(abs(r.gradient) for r in found) < 1e-6
    if classes > 1:
        model.coefficients[0][0] += 0.1
        assert max(abs(r.gradient) for r in optimality(df, "y", model, config).collect()) > 1e-4
