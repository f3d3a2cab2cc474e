"""Features, z-scores and the spread plans behind them."""
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from conftest import T0, at, rows_of
from opslake.functions.scalars import epoch_seconds
from opslake.operators.features import FeatureConfig, extract_features, history_features
from opslake.operators.zscore import ZScoreConfig, zscore_anomalies
from opslake.plans.ordering import quantiles, running_totals
from opslake.plans.slicing import over_ordered


def test_rolling_and_delta_values(telemetry):
    t = telemetry([(i * 10, "database", {"cpu_usage_pct": v}) for i, v in enumerate((10.0, 20.0, 30.0, 40.0))])
    f = history_features(t, mode="plain").orderBy("timestamp").select(
        "cpu_usage_pct_roll_mean_3", "cpu_usage_pct_roll_max_3", "cpu_usage_pct_delta_1", "cpu_usage_pct_roll_std_3").collect()
    assert [r[0] for r in f] == [10, 15, 20, 30]
    assert [r[1] for r in f] == [10, 20, 30, 40]
    assert [r[2] for r in f] == [0, 10, 10, 10]
    assert abs(f[2][3] - np.std([10, 20, 30])) < 1e-12 and f[0][3] == 0


def test_services_do_not_mix(telemetry):
    t = telemetry([(0, "database", {"cpu_usage_pct": 10.0}), (0, "api_gateway", {"cpu_usage_pct": 80.0}),
                   (10, "database", {"cpu_usage_pct": 20.0}), (10, "api_gateway", {"cpu_usage_pct": 90.0})])
    f = extract_features(t, FeatureConfig(windows=(2,), steps=(1,)), "plain").where("service = 'api_gateway'")
    got = rows_of(f.select("timestamp", "cpu_usage_pct_delta_1", "cpu_usage_pct_roll_mean_2"), "timestamp")
    assert [g[1:] for g in got] == [(0.0, 80.0), (10.0, 85.0)]


def test_no_nulls_and_column_count(telemetry):
    t = telemetry([(i * 10, s, {}) for i in range(4) for s in ("database", "api_gateway")])
    f = extract_features(t, mode="plain")
    assert len(f.columns) == 12 + 63 + 28 + 4 + 4
    assert f.dropna().count() == f.count() == 8


def _wave(n, gap=3600, seed=1):
    rnd = random.Random(seed)
    clock, out = 0, []
    for i in range(n):
        clock += gap * rnd.choice((1, 1, 1, 30, 200))
        for s in ("database", "api_gateway"):
            if rnd.random() < 0.9:
                out.append((clock, s, {"latency_ms": rnd.uniform(1, 99), "cpu_usage_pct": rnd.uniform(0, 99)}))
    return out


def test_future_does_not_change_the_past(telemetry):
    rows = _wave(40)
    cut = rows[50][0]
    changed = [(t, s, {**v, "latency_ms": 9e3}) if t > cut else (t, s, v) for t, s, v in rows]
    for fn in (lambda d: zscore_anomalies(d, mode="plain"),
               lambda d: history_features(d, FeatureConfig(windows=(3,), steps=(1,), metrics=("latency_ms",)), "plain")):
        past = [rows_of(fn(telemetry(r)).where(F.col("timestamp") <= F.lit(at(cut)).cast("timestamp_ntz")), "timestamp", "service")
                for r in (rows, changed)]
        assert past[0] == past[1] and past[0]


def test_short_history_scores_zero(telemetry):
    t = telemetry([(i * 10, "database", {"latency_ms": v}) for i, v in enumerate((5.0, 500.0, 5.0, 900.0))])
    assert {(r.anomaly_score, r.is_anomaly, r.anomalous_metrics) for r in zscore_anomalies(t).collect()} == {(0.0, False, "")}


def test_spike_is_flagged_with_its_metrics(telemetry):
    rows = [(i * 10, "database", {"latency_ms": 20.0 + i % 2}) for i in range(20)]
    rows[15] = (150, "database", {"latency_ms": 400.0, "error_rate": 0.9})
    hit = zscore_anomalies(telemetry(rows), ZScoreConfig()).where("is_anomaly").collect()
    assert [(r.timestamp, r.anomalous_metrics) for r in hit] == [(at(150), "latency_ms,error_rate")]


def test_without_metric_columns(telemetry):
    t = telemetry([(0, "database", {})]).select("timestamp", "service")
    assert zscore_anomalies(t).first()[2:] == (0.0, False, "")


def test_spread_windows_equal_plain_ones(telemetry):
    t = telemetry(_wave(120)).repartition(3)
    cfg = FeatureConfig(windows=(3, 12), steps=(1, 3), metrics=("latency_ms",))
    for fn in (lambda m: zscore_anomalies(t, mode=m), lambda m: history_features(t, cfg, m)):
        assert rows_of(fn("plain"), "timestamp", "service") == rows_of(fn("spread"), "timestamp", "service")


def test_halo_reaches_over_thin_and_thick_slices(telemetry):
    t = telemetry(_wave(150, gap=60, seed=5)).select("timestamp", "service", "latency_ms")

    def add(df, part):
        w = Window.partitionBy(*part).orderBy("timestamp").rowsBetween(-7, -1)
        return df.withColumn("seen", F.collect_list("latency_ms").over(w))

    plain = rows_of(add(t, ["service"]), "timestamp", "service")
    for width in (60, 900, 20_000, 10**9):
        spread = over_ordered(t, ["service"], ["timestamp"], add, 7, F.floor(epoch_seconds(F.col("timestamp")) / width), "spread")
        assert rows_of(spread.select("timestamp", "service", "latency_ms", "seen"), "timestamp", "service") == plain


def test_slices_shrink_for_a_busy_service(telemetry):
    from opslake.plans.slicing import fitting_time_slice

    t = telemetry([(i * 60, "database", {}) for i in range(1440)])
    sizes = [fitting_time_slice("timestamp", ["service"], n)(t).groupBy("_slice").count().agg(F.max("count")).first()[0]
             for n in (10_000, 100)]
    assert sizes == [1440, 100]


def test_running_totals_and_quantiles_on_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(4)}", rnd.randrange(60) / 4) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, v double")
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    totals = [rows_of(running_totals(counts, ["g"], ["v"], {"cum": "n"}, m), "g", "v") for m in ("plain", "spread")]
    assert totals[0] == totals[1]
    probs = {"a": 0.1, "b": 0.5, "c": 0.95}
    for mode in ("plain", "spread"):
        for r in quantiles(df, ["g"], "v", probs, mode).collect():
            want = np.percentile([v for g, v in rows if g == r.g], [10, 50, 95])
            assert np.allclose([r.a, r.b, r.c], want, atol=1e-12)


def _odd_rows(spark):
    """Rows with null services, null times and repeats, over several days."""
    from datetime import timedelta

    from conftest import T0

    rows = [(T0 + timedelta(hours=i), ("a", None, "b")[i % 3], float(i * i % 37)) for i in range(300)]
    rows += [(None, ("a", None)[i % 2], float(i)) for i in range(8)] + rows[:5]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, service string, value double")


def test_spread_windows_keep_null_keys(spark):
    from pyspark.sql import Window, functions as F

    from opslake.plans.slicing import over_ordered, time_slice

    def sums(df, keys):
        w = Window.partitionBy(*keys).orderBy("timestamp", "value").rowsBetween(-5, -1)
        return df.withColumn("s", F.sum("value").over(w))

    df = _odd_rows(spark)
    got = [sorted(map(str, over_ordered(df, ["service"], ["timestamp", "value"], sums, 5, time_slice(F.col("timestamp"), 7200), mode)
                      .select("timestamp", "service", "value", "s").collect())) for mode in ("plain", "spread")]
    assert got[0] == got[1] and len(got[0]) == 313


def test_spread_quantiles_keep_the_null_group(spark):
    from opslake.plans.ordering import quantiles

    df = _odd_rows(spark)
    got = [sorted(map(str, quantiles(df, ["service"], "value", {"q": 0.9}, mode).collect())) for mode in ("plain", "spread")]
    assert got[0] == got[1] and len(got[0]) == 3


def test_thin_services_get_wide_slices(spark):
    from pyspark.sql import functions as F

    from opslake.plans.slicing import _halo_rows, fitting_time_slice

    busy = spark.range(20_000).select(F.timestamp_seconds(F.col("id") * 130).cast("timestamp_ntz").alias("timestamp"), F.lit("busy").alias("service"))
    thin = spark.range(60).select(F.timestamp_seconds(F.col("id") * 43_200).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("string").alias("service"))
    df = busy.unionByName(thin)
    rows = fitting_time_slice("timestamp", ["service"], target_rows=500)(df)
    n = {r["service"]: r["n"] for r in rows.groupBy("service").agg(F.countDistinct("_slice").alias("n")).collect()}
    assert n["busy"] > 25 and n[None] == 1
    assert rows.count() == df.count() and _halo_rows(rows, ["service"], ["timestamp"], 30).count() < 20_060


@pytest.mark.parametrize("block,mode", [(2, "plain"), (3, "spread"), (32, "plain")])
def test_ewma_equals_the_recurrence(spark, telemetry, monkeypatch, block, mode):
    """Any block size, several levels, missing values first and in between, a null service and a service with one row."""
    import random

    from opslake.operators.features import ewma_features
    from opslake.plans import scan

    monkeypatch.setattr(scan, "BLOCK", block)
    rng = random.Random(3)
    rows = [(i * 10, s, {"latency_ms": None if i in (0, 7) or rng.random() < 0.1 else rng.uniform(1, 900)}) for i in range(41) for s in ("database", None)]
    rows += [(5, "api_gateway", {"latency_ms": 4.0})]
    want = {}
    for s in ("database", None, "api_gateway"):
        total = weight = 0.0
        for at_, svc, m in rows:
            if svc == s:
                x = m["latency_ms"]
                if x is not None:
                    total, weight = 0.7 * total + x, 0.7 * weight + 1
                want[at_, s] = total / weight if weight else None
    got = ewma_features(telemetry(rows), ("latency_ms",), 0.3, mode)
    assert got.columns[-1] == "latency_ms_ewma"
    found = {((r.timestamp - T0).seconds, r.service): r.latency_ms_ewma for r in got.collect()}
    assert set(found) == set(want)
    assert all(found[k] == want[k] if want[k] is None else found[k] == pytest.approx(want[k], rel=1e-12) for k in want)
