import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import at
from opslake.operators.drift import drift_report, feature_drift, feature_shape, psi_values, value_counts
from opslake.operators.health import model_health, prediction_distribution
from opslake.operators.metrics import (
    anomaly_metrics, binary_metrics, detection_delays, lead_times, mean_detection_delay, metric_degradation,
    ranking_quality, rca_metrics, severity_confusion, severity_metrics)


def test_binary_metrics(spark):
    df = spark.createDataFrame([(False, False), (False, True), (True, True), (True, True)], "t boolean, p boolean")
    r = binary_metrics(df, "t", "p").first()
    assert (r.precision, r.recall, r.f1_score) == (0.6667, 1.0, 0.8)
    empty = binary_metrics(df.where("false"), "t", "p").first()
    assert (empty.precision, empty.recall, empty.f1_score) == (0.0, 0.0, 0.0)


def test_detection_delay_and_counts(spark, incidents):
    flags = [(at(s), "database", f) for s, f in ((0, False), (10, True), (20, True), (30, True), (40, False))]
    pred = spark.createDataFrame(flags, "timestamp timestamp_ntz, service string, is_anomaly boolean")
    truth = pred.select("timestamp", "service", (F.col("timestamp") < F.lit(at(40)).cast("timestamp_ntz")).alias("is_incident"))
    r = anomaly_metrics(pred, truth).first()
    assert (r.true_positives, r.false_negatives, r.false_positives, r.unmatched) == (3, 1, 0, 0)
    inc = incidents({"root": "database", "start": 0, "end": 30}, {"root": "api_gateway", "start": 0, "end": 30})
    assert mean_detection_delay(detection_delays(pred, inc)).first()[:] == (10.0, 1)
    assert mean_detection_delay(detection_delays(pred.where("false"), inc)).first()[0] is None
    rootless = incidents({"affected": ["database"], "start": 15, "end": 30})
    assert detection_delays(pred, rootless).first().delay_seconds == 5.0


def test_lead_time(spark, incidents):
    pred = spark.createDataFrame([(at(s), "database", s == 10) for s in range(0, 60, 10)],
                                 "timestamp timestamp_ntz, service string, is_predicted_incident boolean")
    inc = incidents({"root": "database", "start": 40, "end": 60})
    assert lead_times(pred, inc, 1800).first().lead_seconds == 30.0
    assert lead_times(pred, inc, 20).count() == 0
    assert lead_times(pred, incidents({"affected": [], "start": 40, "end": 60}), 1800).first().lead_seconds == 30.0


@pytest.mark.parametrize("mode", ["plain", "spread"])
def test_ranking_quality_against_pairs(spark, mode):
    rnd = random.Random(2)
    rows = [(rnd.random() < 0.3, rnd.randrange(20) / 7) for _ in range(300)]
    r = ranking_quality(spark.createDataFrame(rows, "t boolean, s double"), "t", "s", (), mode).first()
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    ap, before = 0.0, 0
    for cut in sorted({s for _, s in rows}, reverse=True):
        tp = sum(p >= cut for p in pos)
        ap += (tp - before) / len(pos) * tp / (tp + sum(q >= cut for q in neg))
        before = tp
    assert (r.roc_auc, r.pr_auc) == (round(auc, 4), round(ap, 4))


def test_one_class_quality(spark):
    df = spark.createDataFrame([(True, 0.2), (True, 0.7)], "t boolean, s double")
    assert ranking_quality(df, "t", "s").first()[:2] == (1.0, 1.0)
    assert ranking_quality(df.withColumn("t", F.lit(False)), "t", "s").first()[:2] == (0.0, 0.0)


def test_severity_metrics(spark):
    pairs = list(zip(("low", "low", "medium", "high", "critical"), ("low", "medium", "medium", "high", "critical")))
    df = spark.createDataFrame(pairs, "severity string, predicted_severity string")
    got = {r.label: r for r in severity_metrics(df).collect()}
    assert got["low"].recall == 0.5 and got["critical"].f1_score == 1.0 and len(got) == 4
    assert severity_confusion(df).count() == 16 and severity_confusion(df).agg(F.sum("n")).first()[0] == 5
    only = severity_metrics(df.where("severity = 'high'"), labels=("high",)).collect()
    assert len(only) == 4 and {r.macro_f1 for r in only} == {1.0}
    assert severity_metrics(df.where("false"), labels=()).count() == 0


def test_rca_metrics(spark, incidents):
    inc = incidents(*[{"id": i, "root": "x", "start": 0, "end": 1} for i in "abc"], {"id": "d", "start": 0, "end": 1})
    ranked = spark.createDataFrame([(i, "x" if k == n else f"s{k}", k) for i, n in (("a", 2), ("b", 3), ("c", 4))
                                    for k in range(1, 5)], "incident_id string, service string, rank bigint")
    assert rca_metrics(ranked, inc).first()[:] == (0.0, 0.6667, 0.3611, 4, 3, 1)


def test_degradation(spark):
    def side(**kv):
        return spark.createDataFrame(list(kv.items()), "metric string, value double")

    got = metric_degradation(side(f1=.85, precision=.80, recall=.90, extra=1.0), side(f1=.70, precision=.65, recall=.89), 0.10)
    assert {r.metric: r.degraded for r in got.collect()} == {"f1": True, "precision": True, "recall": False}
    assert {r.metric: r.drop for r in got.collect()}["f1"] == round(.15 / .85, 4)


def _psi(ref, cur):
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    a, b = (np.maximum(np.histogram(x, edges)[0] / len(x), 1e-4) for x in (ref, cur))
    a, b = a / a.sum(), b / b.sum()
    return float(((b - a) * np.log(b / a)).sum())


@pytest.mark.parametrize("mode", ["plain", "spread"])
def test_psi_and_ks_against_numpy(spark, mode):
    rng = np.random.default_rng(4)
    ref, cur = {}, {}
    for name, shift in (("same", 0.0), ("moved", 0.8), ("ties", 0.0)):
        ref[name], cur[name] = rng.normal(0, 1, 400), rng.normal(shift, 1, 300)
        if name == "ties":
            ref[name], cur[name] = np.round(ref[name]), np.round(cur[name] * 1.5)
    frames = [spark.createDataFrame([tuple(map(float, r)) for r in zip(*d.values())], [*d]) for d in (ref, cur)]
    counts = value_counts(*frames, list(ref), mode)
    shape = feature_shape(counts)
    psi = {r.feature: r.psi for r in psi_values(counts, shape).collect()}
    for r in shape.collect():
        grid = np.unique(np.concatenate([ref[r.feature], cur[r.feature]]))
        cdf = [np.searchsorted(np.sort(x), grid, "right") / len(x) for x in (ref[r.feature], cur[r.feature])]
        assert math.isclose(r.ks_statistic, np.abs(cdf[0] - cdf[1]).max(), abs_tol=1e-12)
        assert math.isclose(psi[r.feature], _psi(ref[r.feature], cur[r.feature]), abs_tol=1e-9)
    verdict = {r.feature: r.status for r in feature_drift(*frames, mode=mode).collect()}
    assert verdict["same"] == "NO_DRIFT" and verdict["moved"] == "DRIFT"


def test_drift_corner_cases(spark):
    ref = spark.createDataFrame([(10.0, 10.0, 1.0, None, 5.0)] * 20, "a double, b double, gone double, empty double, flat double")
    cur = spark.createDataFrame([(10.0, 20.0, None, 5.0 + i) for i in range(20)], "a double, b double, empty double, flat double")
    verdicts = feature_drift(ref, cur)
    got = {r.feature: r for r in verdicts.collect()}
    assert (got["a"].status, got["a"].psi, got["a"].ks_p_value) == ("NO_DRIFT", 0.0, 1.0)
    assert (got["b"].status, got["b"].psi, got["b"].ks_statistic, got["b"].ks_p_value) == ("DRIFT", 1.0, 1.0, 0.0)
    assert got["gone"].status == "MISSING" and got["gone"].is_drift
    assert got["empty"].status == "INSUFFICIENT_DATA" and not got["empty"].is_drift
    assert got["flat"].psi == 1.0
    r = drift_report(verdicts, ref, cur).first()
    assert r.drifted_features == ["b", "flat", "gone"] and r.drift_share == 0.6 and (r.reference_count, r.current_count) == (20, 20)


def test_health_levels(telemetry):
    t = telemetry([(i * 10, "database", {"latency_ms": 20.0 + i}) for i in range(30)])
    calm = model_health(t, t, 100.0).first()
    assert calm.health_status == "NORMAL" and "healthy" in calm.status_reasons[0]
    assert model_health(t, t, 600.0).first().health_status == "WARNING"
    assert model_health(t, None, 1200.0).first().health_status == "CRITICAL"
    assert model_health(t.drop("error_rate"), None, 1.0).first().health_status == "CRITICAL"
    moved = t.withColumn("latency_ms", F.col("latency_ms") + 500)
    assert model_health(moved, t, 1.0).first().health_status == "WARNING"


def test_prediction_distribution(spark):
    scores = [i / 10 for i in range(11)]
    df = spark.createDataFrame([(s, s > 0.75) for s in scores], "incident_probability double, is_predicted_incident boolean")
    r = prediction_distribution(df).first()
    assert (r.total_predictions, r.positive_predictions, r.positive_rate) == (11, 3, 0.2727)
    assert (r.score_p50, r.score_p90, r.score_p99) == tuple(round(float(np.percentile(scores, p)), 4) for p in (50, 90, 99))
    assert prediction_distribution(df.where("false")).first()[:] == (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_exact_ks_tail_counts_all_orders():
    """Against the share of all orders of both samples that are at least as far apart, for every distance there is."""
    from fractions import Fraction
    from itertools import combinations
    from math import comb

    from opslake.operators.drift import exact_ks_tail

    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 4), (3, 8)):
        far = []
        for mine in combinations(range(n + m), n):
            i, most = 0, Fraction(0)
            for k in range(n + m):
                i += k in mine
                most = max(most, abs(Fraction(i, n) - Fraction(k + 1 - i, m)))
            far.append(most)
        for d in set(far) | {Fraction(0)}:
            want = sum(f >= d for f in far) / comb(n + m, n)
            assert exact_ks_tail(float(d), n, m) == pytest.approx(want, rel=1e-12)


def test_exact_ks_tail_of_large_and_distant_samples():
    from math import comb

    from opslake.operators.drift import exact_ks_tail

    assert exact_ks_tail(1.0, 300, 200) == pytest.approx(2 / comb(500, 200), rel=1e-9)
    # Of equal sizes, two-sided, by reflections of the path at the band's borders.
    n, h = 1500, 61
    want = 2 * sum((-1) ** (k + 1) * (comb(2 * n, n - k * h) / comb(2 * n, n)) for k in range(1, n // h + 1))
    assert exact_ks_tail(h / n, n, n) == pytest.approx(want, rel=1e-9)
    assert exact_ks_tail(0.02, 10_000, 9_999) == pytest.approx(0.0366, abs=2e-3)  # the asymptotic series is near


def test_messages(spark):
    a = spark.createDataFrame([(float(i), 1.0, 2.0, 5.0) for i in range(50)], "x double, flat double, moved double, gone double")
    b = spark.createDataFrame([(float(i + 40), 1.0, 3.0) for i in range(50)], "x double, flat double, moved double")
    said = {r.feature: r.message for r in feature_drift(a, b).collect()}
    assert said["flat"] == "Constant identical values across datasets." and said["moved"] == "Constant value shifted completely."
    assert said["gone"] == "Feature 'gone' missing from current dataset."
    assert said["x"].startswith("Significant drift (PSI=") and "KS=0.8000, p=" in said["x"]


@pytest.mark.parametrize("cells", [1, 4, 4096])
def test_next_event_equals_a_scan(spark, monkeypatch, cells):
    """Ties, points before, between and after all events, keys without events, null keys and times; columns of the join's own names."""
    from opslake.plans import nextevent

    monkeypatch.setattr(nextevent, "CELLS", cells)
    rng = random.Random(9)
    keys = ["a", "b", None, "quiet"]
    events = [(k, rng.randrange(0, 400)) for k in keys[:3] for _ in range(25)] + [("a", 77), ("a", 77)]
    points = [(i, rng.choice(keys), rng.randrange(-50, 450)) for i in range(150)] + [(900, "a", 77), (901, "a", None)]
    e = spark.createDataFrame([(k, at(s)) for k, s in events] + [("a", None)], "service string, timestamp timestamp_ntz")
    p = spark.createDataFrame([(i, k, at(s) if s is not None else None, "x") for i, k, s in points], "id int, service string, since timestamp_ntz, _cell string")
    for by in (["service"], []):
        def first(k, s):
            later = [x for other, x in events if s is not None and x >= s and (not by or other == k)]
            return at(min(later)) if later else None

        got = nextevent.next_event(p, e, "since", by)
        assert got.columns == ["id", "service", "since", "_cell", "next_event"]
        assert {r.id: r.next_event for r in got.collect()} == {i: first(k, s) for i, k, s in points}
    none = nextevent.next_event(p, e.limit(0), "since", ["service"]).collect()
    assert len(none) == len(points) and not any(r.next_event for r in none)
