import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import T0, at, rows_of
from opslake.operators.labels import active_window_labels, before_incidents, horizon_labels, incident_labels, severity_labels
from opslake.operators.prep import chronological_split, positional_split, scale, scaler_stats

MIN = 60


def _series(telemetry, n, step=10 * MIN, service="database"):
    return telemetry([(i * step, service, {}) for i in range(n)])


def test_horizon_modes(telemetry, incidents):
    t = _series(telemetry, 6)
    inc = incidents({"root": "database", "affected": ["database"], "start": 30 * MIN, "end": 50 * MIN})
    flags = [[r[2] for r in rows_of(horizon_labels(t, inc, 1200, lead_time_only=lead), "timestamp")] for lead in (False, True)]
    assert flags == [[False, True, True, True, True, True], [False, True, True, False, False, False]]


def test_horizon_service_scope(telemetry, incidents):
    t = _series(telemetry, 3, service="auth_service")
    here = {"root": "database", "affected": ["database"], "start": 0, "end": 30 * MIN}
    assert not any(r[2] for r in horizon_labels(t, incidents(here), 0).collect())
    assert all(r[2] for r in horizon_labels(t, incidents(here), 0, service_specific=False).collect())
    assert all(r[2] for r in horizon_labels(t, incidents({**here, "affected": []}), 0).collect())


def test_severity_labels(telemetry, incidents):
    t = _series(telemetry, 5)
    inc = incidents({"root": "database", "affected": ["database"], "start": 10 * MIN, "end": 30 * MIN, "severity": "CRITICAL"})
    assert [r[2] for r in rows_of(severity_labels(t, inc), "timestamp")] == [None, "critical", "critical", "critical", None]
    every = incidents({"affected": [], "start": 0, "end": 10 * MIN, "severity": "low"},
                      {"affected": ["database"], "start": 10 * MIN, "end": 20 * MIN, "severity": "high"})
    assert [r[2] for r in rows_of(severity_labels(t, every), "timestamp")] == ["low", "high", "high", None, None]


def test_overlap_last_wins_and_root_is_independent(telemetry, incidents):
    t = telemetry([(0, "database", {}), (0, "api_gateway", {}), (600, "database", {}), (600, "auth_service", {})])
    inc = incidents({"id": "A", "root": "auth_service", "affected": ["database", "api_gateway"], "start": 0, "end": 600},
                    {"id": "B", "root": "database", "affected": None, "start": 600, "end": 900})
    assert rows_of(incident_labels(t, inc).select("timestamp", "service", "is_incident", "is_root_cause", "incident_id"),
                   "timestamp", "service") == [
        (at(0), "api_gateway", True, False, "A"), (at(0), "database", True, False, "A"),
        (at(600), "auth_service", False, True, None), (at(600), "database", True, True, "B")]


def test_labels_do_not_depend_on_slice_width(telemetry, incidents):
    t = _series(telemetry, 40)
    inc = incidents(*[{"root": "database", "start": i * 1000, "end": i * 1000 + 5000, "id": str(i)} for i in range(12)])
    got = [rows_of(incident_labels(t, inc, w), "timestamp") for w in (300, 7200, 10**7)]
    assert got[0] == got[1] == got[2]


def test_salted_merge_join_equals_broadcast(telemetry, incidents, monkeypatch):
    from opslake.plans import intervals

    monkeypatch.setattr(intervals, "SALT_ROWS", 3)
    t = telemetry([(i * 300, s, {}) for i in range(60) for s in ("database", "api_gateway")]).select("timestamp", "service")
    inc = incidents(*[{"root": "database", "start": i * 900, "end": i * 900 + 4000, "id": str(i % 3)} for i in range(15)])
    ranges = inc.select("ord", "incident_id", F.col("start_time").alias("from_ts"), F.col("end_time").alias("to_ts"))
    named = ranges.withColumn("service", F.lit("database"))
    for r, on in ((ranges, False), (named, True)):
        got = [rows_of(intervals.attach_max(t, r, on, {"last": F.col("ord")}, w, max_rows=m, mode=how), "timestamp", "service")
               for m, w, how in ((10**6, None, "plain"), (10**6, 3600, "spread"), (0, 40, "plain"), (0, 10**6, "spread"))]
        assert got[0] == got[1] == got[2] == got[3] and any(g[2] is not None for g in got[0])


@pytest.mark.parametrize("crowd,finest", [(32, 20), (1, 3), (1, 20)])
def test_overlaps_of_all_kinds(spark, telemetry, monkeypatch, crowd, finest):
    """Winner and flag of each row against a scan of all ranges: nested, touching, equal, empty and open-ended ones."""
    import random

    from opslake.plans import intervals

    monkeypatch.setattr(intervals, "CROWD", crowd)
    monkeypatch.setattr(intervals, "FINEST", finest)
    rng = random.Random(7)
    points = [(rng.randrange(0, 5000) / 10, rng.choice(["database", "api_gateway", None])) for _ in range(300)]
    spans = [(rng.randrange(0, 500), rng.randrange(0, 500), rng.choice(["database", "api_gateway", None])) for _ in range(120)]
    spans += [(s, s, "database") for s in range(0, 400, 50)] + [(-10**9, 10**9, "api_gateway"), (100, 10**9, None)]
    t = telemetry([(s, svc, {}) for s, svc in points]).select("timestamp", "service")
    r = spark.createDataFrame([(i, at(a), at(b), svc) for i, (a, b, svc) in enumerate(spans)] + [(999, None, at(5), "database")],
                              "ord bigint, from_ts timestamp_ntz, to_ts timestamp_ntz, service string")
    for on in (True, False):
        for open_ in (True, False):
            def best(s, svc):
                return max((i for i, (a, b, other) in enumerate(spans)
                            if a <= s and (s < b if open_ else s <= b) and a <= b and (not on or (svc is not None and svc == other))), default=None)

            got = intervals.attach_max(t, r, on, {"last": F.col("ord"), "odd": F.col("ord") % 2 == 1}, until_open=open_)
            assert sorted((str(x.timestamp), str(x.service), x.last) for x in got.collect()) == sorted(
                ((str(at(s)), str(svc), best(s, svc)) for s, svc in points), key=lambda x: x[:2] + (x[2],))


def test_ten_thousand_overlapping_incidents(spark, telemetry):
    """All in one hour of one service: the last one listed wins, and no array of ranges is built."""
    from opslake.plans.intervals import attach_max

    t = telemetry([(i, "database", {}) for i in range(0, 3600, 40)]).select("timestamp", "service")
    r = spark.range(10_000).select(
        F.col("id").alias("ord"), F.lit("database").alias("service"),
        F.expr(f"timestamp_ntz'{T0}' + make_dt_interval(0, 0, 0, id % 1800)").alias("from_ts"),
        F.expr(f"timestamp_ntz'{T0}' + make_dt_interval(0, 0, 0, id % 1800 + 1 + id % 1701)").alias("to_ts"))
    got = attach_max(t, r, True, {"last": F.col("ord")})
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {s: max((i for i in range(10_000) if i % 1800 <= s <= i % 1800 + 1 + i % 1701), default=None) for s in range(0, 3600, 40)}
    assert {(x.timestamp - T0).seconds: x.last for x in got.collect()} == want


def test_copies_shrink_but_the_last_one_wins(telemetry, incidents):
    t = _series(telemetry, 6)
    inc = incidents(*[{"root": "database", "start": 0, "end": 40 * MIN, "id": str(i)} for i in range(50)])
    assert [r[4] for r in rows_of(incident_labels(t, inc), "timestamp")] == ["49"] * 5 + [None]


def test_active_window_and_slice_before(telemetry, incidents):
    t = _series(telemetry, 4)
    inc = incidents({"root": "api_gateway", "affected": ["api_gateway"], "start": 10 * MIN, "end": 20 * MIN, "severity": "High"})
    assert [r[2:] for r in rows_of(active_window_labels(t, inc), "timestamp")] == [(0, "low"), (1, "High"), (1, "High"), (0, "low")]
    assert before_incidents(t, inc).count() == 1


@pytest.mark.parametrize("mode", ["plain", "spread"])
def test_chronological_split(telemetry, mode):
    t = telemetry([(i * 10, s, {}) for i in range(10) for s in ("database", "api_gateway")])
    n = {r["split"]: r["count"] for r in chronological_split(t, 0.6, 0.2, 0.2, mode).groupBy("split").count().collect()}
    assert n == {"train": 12, "validation": 4, "test": 4}
    with pytest.raises(ValueError):
        chronological_split(t, 0.6, 0.6, 0.2)


def test_split_truncates_like_double_arithmetic(telemetry):
    t = _series(telemetry, 360, 10)
    train = chronological_split(t, 1 - (0.15 + 0.15), 0.15, 0.15, "plain").where("split = 'train'").count()
    assert train == int(360 * (1 - (0.15 + 0.15))) == 251


def test_positional_split(telemetry):
    t = telemetry([(i * 10, s, {}) for i in range(5) for s in ("database", "api_gateway")]).select("timestamp", "service")
    for mode in ("plain", "spread"):
        got = rows_of(positional_split(t, 0.25, mode), "timestamp", "service")
        assert [g[2] for g in got] == ["train"] * 7 + ["test"] * 3


def test_scaler_equals_impute_then_scale(spark):
    vals = [1.0, None, 4.0, float("inf"), 7.5, float("nan"), -2.0]
    df = spark.createDataFrame([(i, v, 3.0) for i, v in enumerate(vals)], "i int, a double, b double")
    stats = {r["feature"]: r.asDict() for r in scaler_stats(df, ["a", "b"]).collect()}
    ok = [v for v in vals if v is not None and np.isfinite(v)]
    full = np.array([v if v in ok else np.median(ok) for v in vals])
    assert stats["a"]["n_missing"] == 3
    assert np.allclose([stats["a"][k] for k in ("median", "mean", "std")], [np.median(ok), full.mean(), full.std()])
    out = scale(df, list(stats.values())).orderBy("i").collect()
    assert np.allclose([r.a for r in out], (full - full.mean()) / full.std()) and {r.b for r in out} == {0.0}
