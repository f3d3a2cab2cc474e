import pytest
from pyspark.sql import functions as F

from conftest import at, rows_of
from opslake.operators.drift import feature_drift
from opslake.operators.labels import incident_labels
from opslake.operators.zscore import ZScoreConfig, zscore_anomalies, zscore_frame
from opslake.streaming import detect, rollup, run, state


@pytest.fixture(scope="module")
def landed(telemetry, tmp_path_factory, spark):
    """Telemetry in five files, oldest first, and the same rows as a table."""
    base = tmp_path_factory.mktemp("landed") / "in.parquet"
    rows = [(i * 60, s, {"latency_ms": 20.0 + (i * 7 + len(s)) % 5 + (300 if i == 77 else 0)}) for i in range(100)
            for s in ("database", "api_gateway")]
    t = telemetry(rows)
    import time

    for k in range(5):
        part = t.where((F.col("timestamp") >= F.lit(at(k * 1200)).cast("timestamp_ntz"))
                       & (F.col("timestamp") < F.lit(at((k + 1) * 1200)).cast("timestamp_ntz")))
        part.coalesce(1).write.mode("append").parquet(str(base))
        time.sleep(0.05)
    return str(base), t


def test_stream_zscores_equal_batch_over_many_batches(spark, landed):
    path, t = landed
    stream = run.table_stream(spark, path, t.schema, files_per_batch=1)
    for mode in ("plain", "spread"):
        scores, late = detect.stream_zscores(stream, mode=mode)
        assert rows_of(scores, "timestamp", "service") == rows_of(zscore_anomalies(t, mode="plain"), "timestamp", "service")
        assert late.count() == 0


def test_late_rows_are_counted_not_scored(spark, landed, telemetry, tmp_path):
    import time

    path = str(tmp_path / "late")
    telemetry([(i * 60, "database", {}) for i in range(20)]).coalesce(1).write.parquet(path)
    time.sleep(0.05)
    telemetry([(300, "database", {}), (1200, "database", {"latency_ms": 400.0}), (0, "api_gateway", {})]).coalesce(1) \
        .write.mode("append").parquet(path)
    scores, late = detect.stream_zscores(run.table_stream(spark, path, landed[1].schema, files_per_batch=1))
    assert [r.timestamp for r in late.collect()] == [at(300)]
    assert scores.count() == 22 and scores.where("is_anomaly").first().timestamp == at(1200)


def test_labels_and_drift_per_batch(spark, landed, incidents, tmp_path):
    path, t = landed
    inc = incidents({"root": "database", "affected": ["database"], "start": 600, "end": 3000})
    out = str(tmp_path / "labels")
    run.run_batches(run.table_stream(spark, path, t.schema, files_per_batch=2), detect.label_batches(inc, out))
    got = spark.read.option("recursiveFileLookup", True).parquet(out)
    assert rows_of(got, "timestamp", "service") == rows_of(incident_labels(t, inc), "timestamp", "service")

    ref = t.where(F.col("timestamp") < F.lit(at(1200)).cast("timestamp_ntz"))
    out = str(tmp_path / "drift")
    run.run_batches(run.table_stream(spark, path, t.schema), detect.drift_batches(ref, out, ["latency_ms", "error_rate"]))
    drift = spark.read.option("recursiveFileLookup", True).parquet(out)
    want = feature_drift(ref, t, ["latency_ms", "error_rate"])
    assert rows_of(drift.drop("batch_id"), "feature") == rows_of(want, "feature")


def test_distinct_drops_copies(spark, tmp_path):
    rows = [(i % 50, at(i % 50)) for i in range(120)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "event_id int, ts timestamp_ntz").write.parquet(path)
    schema = spark.read.parquet(path).schema
    out = run.run_to_table(rollup.stream_distinct(run.table_stream(spark, path, schema), ["event_id"]))
    assert out.count() == 50


def _state_scores(spark, path, schema, per_batch, tmp_path, runs=1):
    for _ in range(runs):
        got = state.stream_zscores_by_state(run.table_stream(spark, path, schema, per_batch), out=str(tmp_path / "out"),
                                            checkpoint=str(tmp_path / "offsets"))
    return got


@pytest.mark.parametrize("per_batch", [1, 2, None])
def test_keyed_state_equals_batch_for_any_cut(spark, landed, tmp_path, per_batch):
    path, t = landed
    scores, late = _state_scores(spark, path, t.schema, per_batch, tmp_path)
    assert rows_of(scores, "timestamp", "service") == rows_of(zscore_anomalies(t, mode="plain"), "timestamp", "service")
    assert late.count() == 0


def test_keyed_state_goes_on_after_a_restart(spark, telemetry, tmp_path):
    import time

    path = str(tmp_path / "in")
    first = telemetry([(i * 60, s, {"latency_ms": float(20 + i % 3)}) for i in range(20) for s in ("database", "api_gateway")])
    second = telemetry([(300, "database", {}), (1200, "database", {"latency_ms": 400.0}), (1260, "database", {"latency_ms": None}),
                        (0, "auth_service", {})])
    first.coalesce(1).write.parquet(path)
    _state_scores(spark, path, first.schema, 1, tmp_path)
    time.sleep(0.05)
    second.coalesce(1).write.mode("append").parquet(path)
    scores, late = _state_scores(spark, path, first.schema, 1, tmp_path, runs=2)
    whole = first.unionByName(second.where(F.col("timestamp") != F.lit(at(300)).cast("timestamp_ntz")))
    assert rows_of(scores, "timestamp", "service") == rows_of(zscore_anomalies(whole, mode="plain"), "timestamp", "service")
    assert rows_of(late, "timestamp") == [(at(300), "database")]


def test_trailing_z_equals_windows_to_the_last_bit(spark, telemetry):
    import numpy as np

    rng = np.random.default_rng(5)
    values = np.where(rng.random((200, 1)) < 0.2, np.nan, np.exp(rng.normal(3, 2, (200, 1))))
    config = ZScoreConfig(metrics=("latency_ms",))
    t = telemetry([(i * 60, "database", {"latency_ms": None if v != v else float(v)}) for i, v in enumerate(values[:, 0])])
    want = [r[0] for r in zscore_frame(t, config, "plain").orderBy("timestamp").select("latency_ms_z").collect()]
    assert state.trailing_z(np.empty((0, 1)), values, config)[:, 0].tolist() == want
    assert state.trailing_z(values[70:100], values[100:], config)[:, 0].tolist() == want[100:]


def test_state_times_out_and_late_rows_are_marked():
    from datetime import timedelta

    import pandas as pd

    class Held:
        hasTimedOut, exists, get, timeout = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):
            self.timeout = ms

    held, step = Held(), state._scorer(["m"], ZScoreConfig(window=3, min_history=1), 2)
    rows = pd.DataFrame({"timestamp": [at(0) + timedelta(microseconds=k) for k in (3, 1, 2, 5, 4)], "m": [1.0, 2.0, None, 4.0, 5.0]})
    out = pd.concat(step(("a",), iter([rows[:2], rows[2:]]), held))
    assert out["m_z"].tolist()[0] == 0 and not out["late"].any() and len(held.get[0]) == 3 and held.get[1][1:] == [5.0, 4.0]
    assert held.timeout == 2 * 86_400_000
    before = held.get
    out = pd.concat(step(("a",), iter([pd.DataFrame({"timestamp": [at(0), None], "m": [1.0, 2.0]})]), held))
    assert out["late"].tolist() == [True, True] and held.get == before
    held.hasTimedOut = True
    assert list(step(("a",), iter([]), held)) == [] and not held.exists
