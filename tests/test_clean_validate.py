import math

import pytest
from pyspark.sql import functions as F

from conftest import at
from opslake.operators.clean import clean_report, clean_telemetry
from opslake.operators.validate import passed, quality_counts, validate_incidents, validate_order, validate_rules

OK = ("database", {})


def _with_seq(df):
    return df.coalesce(1).withColumn("seq", F.monotonically_increasing_id()).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def test_drop_accounting(telemetry):
    rows = [(0, *OK), (10, *OK), (20, "rogue", {}), (30, "other", {}), (40, "database", {"cpu_usage_pct": None}),
            (50, "database", {"latency_ms": math.nan}), (60, " DataBase ", {}), (60, "database", {"cpu_usage_pct": 1.0}),
            (70, "database", {"cpu_usage_pct": 101.0}), (80, "database", {"error_rate": 1.1}),
            (90, "database", {"latency_ms": -1.0}), (100, "database", {"connection_utilization": -0.1})]
    raw = _with_seq(telemetry(rows))
    r = clean_report(raw, "seq").first().asDict()
    assert r == {"input_rows": 12, "output_rows": 3, "unknown_service_rows_dropped": 2, "null_rows_dropped": 2,
                 "duplicate_rows_dropped": 1, "invalid_rows_dropped": 4, "total_dropped": 9}
    kept = clean_telemetry(raw, "seq").orderBy("timestamp").collect()
    assert [k.timestamp for k in kept] == [at(0), at(10), at(60)]
    assert kept[2].cpu_usage_pct == 20.0 and kept[2].service == "database"


def test_first_copy_out_of_bounds_loses_the_key(telemetry):
    raw = _with_seq(telemetry([(0, "database", {"cpu_usage_pct": 150.0}), (0, *OK)]))
    assert clean_telemetry(raw, "seq").count() == 0


def test_headers_are_normalised_and_required(telemetry):
    raw = _with_seq(telemetry([(0, *OK)])).withColumnRenamed("latency_ms", " Latency_MS ")
    assert clean_telemetry(raw, "seq").count() == 1
    with pytest.raises(ValueError):
        clean_telemetry(raw.drop("error_rate"), "seq")
    assert clean_report(_with_seq(telemetry([(0, *OK)])).limit(0), "seq").first().input_rows == 0


@pytest.mark.parametrize("change, rule", [
    ({"cpu_usage_pct": -1.0}, "bounds"), ({"error_rate": 1.2}, "bounds"), ({"connection_utilization": 1.5}, "bounds"),
    ({"network_in_mbps": -1.0}, "negative"), ({"memory_usage_pct": None}, "null_values"), ({"latency_ms": 6000.0}, "latency_high"),
])
def test_one_defect_one_rule(telemetry, change, rule):
    found = validate_rules(telemetry([(0, *OK), (10, "database", change)]))
    assert [r.rule for r in found.collect()] == [rule]
    assert passed(found).first().passed is (rule == "latency_high")


def test_keys_services_and_schema(telemetry):
    t = telemetry([(0, *OK), (0, *OK), (10, "rogue", {})])
    assert {(r.rule, r.n_bad) for r in validate_rules(t).collect()} == {("duplicate_key", 1), ("unknown_service", 1)}
    assert [r.rule for r in validate_rules(t.drop("latency_ms", "error_rate")).collect()] == ["required_columns"] * 2
    text = t.withColumn("timestamp", F.when(F.col("service") == "rogue", "nope").otherwise(F.col("timestamp").cast("string")))
    assert ("timestamp_format", 1) in {(r.rule, r.n_bad) for r in validate_rules(text).collect()}


def test_order_per_service(telemetry):
    t = telemetry([(0, *OK), (20, *OK), (10, *OK), (5, "api_gateway", {}), (5, "api_gateway", {})]).coalesce(1)
    t = t.withColumn("seq", F.monotonically_increasing_id())
    for mode in ("plain", "spread"):
        assert [(r.subject, r.n_bad) for r in validate_order(t, "seq", mode).collect()] == [("database", 1)]


def test_incident_rules(telemetry, incidents):
    t = telemetry([(0, *OK), (100, *OK)])
    inc = incidents({"root": "database", "start": 10, "end": 20}, {"start": 10, "end": 20}, {"root": "rogue", "start": 10, "end": 20},
                    {"root": "database", "start": 30, "end": 20}, {"root": "database", "start": 500, "end": 600})
    assert {(r.rule, r.subject) for r in validate_incidents(inc, t).collect()} == {
        ("incident_keys", "incident 1"), ("incident_root", "incident 2"), ("incident_times", "incident 3"),
        ("incident_span", "incident 4")}


def test_quality(telemetry):
    t = telemetry([(0, "database", {"latency_ms": math.nan}), (10, "database", {"cpu_usage_pct": math.inf})]).drop("error_rate")
    assert {tuple(r) for r in quality_counts(t).collect()} == {
        ("latency_ms", "null", 1), ("cpu_usage_pct", "infinite", 1), ("error_rate", "missing_column", 1)}
