import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import at, rows_of
from opslake.operators import iforest
from opslake.operators.evaluate import detector_benchmark

CFG = iforest.ForestConfig(trees=20, max_samples=64)


@pytest.fixture(scope="module")
def history(telemetry):
    rnd = random.Random(7)
    return telemetry([(i * 60, s, {"latency_ms": rnd.gauss(20, 3), "cpu_usage_pct": rnd.gauss(30, 4),
                                   "error_rate": abs(rnd.gauss(0.002, 0.0005))})
                      for i in range(240) for s in ("database", "api_gateway", "orders_service")]).coalesce(2).persist()


@pytest.fixture(scope="module")
def model(history):
    return iforest.fit_forest(history, CFG)


def test_average_path():
    assert iforest.average_path(np.array([1, 2])).tolist() == [0.0, 1.0]
    assert math.isclose(float(iforest.average_path(256)), 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256, abs_tol=1e-6)


def test_tree_shape(model):
    nodes = model.nodes.toPandas()
    assert set(nodes["model"]) == {"database", "api_gateway", "orders_service"}
    assert nodes.groupby("model")["tree"].nunique().eq(20).all()
    roots = nodes[nodes["node"] == 0]
    assert roots["size"].eq(64).all() and nodes["depth"].max() <= math.ceil(math.log2(64))
    leaves = nodes[nodes["feature"] < 0].groupby(["model", "tree"])["size"].sum()
    assert leaves.eq(64).all()


def test_sample_is_uniform_without_repeats(history):
    inputs = iforest._inputs(history, CFG, list(CFG.features), {})
    drawn = iforest.draw_samples(inputs, CFG)
    per_tree = drawn.groupBy("model", "tree").agg(F.count("*").alias("n"), F.countDistinct("timestamp").alias("d")).collect()
    assert {(r.n, r.d) for r in per_tree} == {(64, 64)}
    assert drawn.select("model", "timestamp").distinct().count() > 600


def test_gate_leaves_enough_rows_in_a_long_history(spark):
    cfg = iforest.ForestConfig(trees=5, max_samples=16)
    rows = spark.range(60_000).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("timestamp"),
                                      F.lit("s").alias("service"), F.lit("s").alias("model"))
    drawn = iforest.draw_samples(rows, cfg).groupBy("tree").agg(F.count("*").alias("n"), F.max("timestamp").alias("m")).collect()
    assert {r.n for r in drawn} == {16} and max(r.m for r in drawn) > at(0).replace(year=1970, hour=12)


def test_forest_does_not_depend_on_partitioning(history, model):
    again = iforest.fit_forest(history.repartition(7, "latency_ms"), CFG)
    a, b = (m.nodes.toPandas().sort_values(["model", "tree", "node"]).reset_index(drop=True) for m in (model, again))
    pd.testing.assert_frame_equal(a, b)


def test_scores(history, model):
    scored = iforest.predict_forest(history, model).toPandas()
    assert scored["anomaly_score"].between(0.2, 1.0).all() and len(scored) == 720
    assert 0.03 <= scored["is_anomaly"].mean() <= 0.07


def test_broadcast_and_cogroup_score_alike(history, model):
    a, b = (rows_of(iforest.predict_forest(history, model, m), "timestamp", "service") for m in ("plain", "spread"))
    assert a == b


def test_other_rows_do_not_matter_and_unknown_services_score_zero(history, model, telemetry):
    one = history.where("service = 'database'").orderBy("timestamp").limit(5)
    many = {(r.timestamp, r.service): r.anomaly_score for r in iforest.predict_forest(history, model).collect()}
    for r in iforest.predict_forest(one, model).collect():
        assert many[(r.timestamp, r.service)] == r.anomaly_score
    stranger = iforest.predict_forest(telemetry([(0, "sidecar", {})]), model).first()
    assert (stranger.anomaly_score, stranger.is_anomaly) == (0.0, False)


def test_gaps_use_training_medians(history, model, telemetry):
    gap = iforest.predict_forest(telemetry([(0, "database", {"latency_ms": float("inf")})]), model).first()
    assert 0 < gap.anomaly_score < 1
    med = iforest.feature_medians(history.withColumn("latency_ms", F.when(F.rand(1) < 0.5, F.col("latency_ms"))), ["latency_ms"])
    assert 18 < med["latency_ms"] < 22


def test_small_groups_and_errors(telemetry):
    single = telemetry([(0, "database", {}), (10, "api_gateway", {}), (20, "api_gateway", {"latency_ms": 90.0})])
    assert {r.model for r in iforest.fit_forest(single, CFG).nodes.select("model").distinct().collect()} == {"api_gateway"}
    with pytest.raises(ValueError):
        iforest.fit_forest(single.limit(0), CFG)
    with pytest.raises(ValueError):
        iforest.fit_forest(single.select("timestamp", "service"), CFG)


def test_one_model_for_all(history):
    cfg = iforest.ForestConfig(trees=10, max_samples=64, per_service=False)
    m = iforest.fit_forest(history, cfg)
    assert m.thresholds.count() == 1
    assert iforest.predict_forest(history, m).where("anomaly_score > 0").count() == 720


def test_save_and_load(history, model, spark, tmp_path):
    model.save(str(tmp_path / "forest"))
    loaded = iforest.ForestModel.load(spark, str(tmp_path / "forest"))
    few = history.limit(50).persist()
    assert rows_of(iforest.predict_forest(few, loaded), "timestamp", "service") == rows_of(
        iforest.predict_forest(few, model), "timestamp", "service")


def test_global_forest_keeps_its_config(history, spark, tmp_path):
    cfg = iforest.ForestConfig(trees=10, max_samples=64, per_service=False, contamination=0.1)
    m = iforest.fit_forest(history, cfg)
    m.save(str(tmp_path / "whole"))
    loaded = iforest.ForestModel.load(spark, str(tmp_path / "whole"))
    assert loaded.config == cfg
    assert iforest.predict_forest(history, loaded).where("is_anomaly").count() == iforest.predict_forest(history, m).where("is_anomaly").count() > 0


def test_gaps_after_training_take_the_training_median(history, model):
    want = history.approxQuantile("latency_ms", [0.5], 0.0)[0]
    assert abs(model.medians["latency_ms"] - want) < 1
    gaps = history.limit(5).withColumn("latency_ms", F.lit(None).cast("double"))
    full = gaps.withColumn("latency_ms", F.lit(model.medians["latency_ms"]))
    assert rows_of(iforest.predict_forest(gaps, model), "timestamp", "service") == rows_of(iforest.predict_forest(full, model), "timestamp", "service")


@pytest.mark.parametrize("mode", ["plain", "spread"])
def test_rows_without_service_are_scored_zero(history, model, mode):
    odd = history.limit(3).unionByName(history.limit(2).withColumn("service", F.lit(None).cast("string")))
    got = iforest.predict_forest(odd, model, mode).collect()
    assert len(got) == 5 and all(r.anomaly_score == 0 and not r.is_anomaly for r in got if r.service is None)


def test_forest_finds_more_of_a_fault_than_the_baseline(history, incidents):
    raised = F.col("timestamp").between(F.lit(at(9000)), F.lit(at(12600)))
    fault = history.withColumns({m: F.when(raised, F.col(m) + add).otherwise(F.col(m)) for m, add in (
        ("latency_ms", 300.0), ("error_rate", 0.2), ("cpu_usage_pct", 30.0))})
    inc = incidents({"root": "database", "affected": ["database", "orders_service", "api_gateway"], "start": 9000, "end": 12600})
    got = {r.detector: r for r in detector_benchmark(fault, inc, forest=CFG).collect()}
    assert got["isolation_forest"].recall > got["statistical_baseline"].recall
    assert got["isolation_forest"].f1_score > 0.6 and got["isolation_forest"].detection_delay_seconds is not None
