import json

import pytest
from pyspark.sql import functions as F

from conftest import at, rows_of
from opslake.session import shared_dir
from opslake.sources import incidents as isource, jsonarrays, registry, telemetry as tsource

DOC = [{"incident_id": "INC-1", "incident_type": "database_connection_saturation", "root_cause_service": "database",
        "affected_services": ["database"], "start_time": "2024-01-01T00:02:30Z", "detection_time": "2024-01-01T00:03:10Z",
        "end_time": "2024-01-01T00:07:30Z", "severity": "critical", "description": "x"},
       {"incident_id": "INC-2", "root_cause_service": "api_gateway", "start_time": "2024-01-01T02:00:00+01:00"}]


@pytest.fixture
def sample(telemetry):
    return telemetry([(i * 10, s, {"latency_ms": float(i)}) for i in range(5) for s in ("database", "api_gateway")])


def test_write_and_read_parquet(spark, sample, tmp_path):
    path = str(tmp_path / "clean.parquet")
    tsource.write_by_date(sample, path)
    tsource.write_by_date(sample, path)
    back = tsource.read_telemetry(spark, path)
    assert rows_of(back.select(*sample.columns), "timestamp", "service") == rows_of(sample, "timestamp", "service")
    with_seq = tsource.read_telemetry(spark, path, with_seq=True)
    assert with_seq.select("ingest_seq").distinct().count() == 10
    plan = back.where("date = '2024-01-01'").select("latency_ms")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "cpu_usage_pct" not in plan


def test_read_csv_and_errors(spark, sample, tmp_path):
    path = str(tmp_path / "t.csv")
    sample.select("service", *[c for c in sample.columns if c != "service"]).write.csv(path, header=True)
    raw = tsource.read_telemetry(spark, path)
    assert dict(raw.dtypes)["timestamp"] == "string" and dict(raw.dtypes)["active_connections"] == "bigint"
    parsed = tsource.read_telemetry(spark, path, parse_timestamps=True)
    assert rows_of(parsed.select(*sample.columns), "timestamp", "service") == rows_of(sample, "timestamp", "service")
    with pytest.raises(FileNotFoundError):
        tsource.read_telemetry(spark, str(tmp_path / "none.parquet"))
    sample.write.json(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        tsource.read_telemetry(spark, str(tmp_path / "t.json"))
    bad = str(tmp_path / "bad.parquet")
    sample.withColumn("error_rate", F.lit(2.0)).write.parquet(bad)
    with pytest.raises(tsource.ContractError, match="error_rate out of bounds"):
        tsource.read_telemetry(spark, bad)
    assert tsource.read_telemetry(spark, bad, validate=False).count() == 10


def test_latest_and_summary(sample):
    assert [(r.timestamp, r.service) for r in tsource.latest(sample, 3).collect()] == [
        (at(40), "api_gateway"), (at(40), "database"), (at(30), "api_gateway")]
    assert tsource.summary(sample).first()[:] == (10, ["api_gateway", "database"], at(0), at(40))
    assert "TakeOrderedAndProject" in tsource.latest(sample, 3)._jdf.queryExecution().executedPlan().toString()


def test_incident_file(spark, tmp_path):
    path = tmp_path / "incidents.json"
    path.write_text(json.dumps(DOC, indent=2))
    rows = isource.read_incidents(spark, str(path)).orderBy("ord").collect()
    assert [(r.ord, r.incident_id, r.affected_services) for r in rows] == [(0, "INC-1", ["database"]), (1, "INC-2", None)]
    assert rows[0].start_time == at(150) and rows[1].start_time == at(3600)
    path.write_text(json.dumps(DOC[0]))
    with pytest.raises(ValueError):
        isource.read_incidents(spark, str(path))
    path.write_text("[]")
    assert isource.read_incidents(spark, str(path)).count() == 0
    with pytest.raises(FileNotFoundError):
        isource.read_incidents(spark, str(tmp_path / "none.json"))


def test_registry(spark, tmp_path):
    path = str(tmp_path / "runs")
    from opslake.schema import RUN

    def run(i, model, **metrics):
        return registry.new_run(model, metrics, run_id=f"r{i}", training_timestamp=f"2024-01-0{i}T00:00:00")

    rows = [run(1, "trees", auc=.41), run(2, "trees", auc=.63), run(3, "trees", hits=12.0), run(4, "linear", auc=.5)]
    for part in (rows[:2], rows[2:]):
        registry.append_runs(spark.createDataFrame(part, RUN), path)
    (tmp_path / "runs" / "broken.json").write_text("{not json\n")
    runs = registry.read_runs(spark, path)
    assert [r.run_id for r in registry.list_runs(runs).collect()] == ["r4", "r3", "r2", "r1"]
    assert [r.run_id for r in registry.list_runs(runs, "linear").collect()] == ["r4"]
    assert [r.run_id for r in registry.compare_runs(runs, "trees", "auc").collect()] == ["r2", "r1", "r3"]
    assert [r.run_id for r in registry.compare_runs(runs, "trees", "auc", descending=False).collect()] == ["r1", "r2", "r3"]
    assert registry.find_run(spark, path, "r2").first().metrics == {"auc": .63}
    with pytest.raises(FileNotFoundError):
        registry.find_run(spark, path, "nope")


def test_artifacts(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.bin").write_bytes(b"1")
    inv = registry.artifact_inventory(spark, str(tmp_path))
    assert {tuple(r) for r in inv.collect()} == {("a.bin", 5), ("b.bin", 1)}


def test_shared_dir_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_default_load_checks_order_and_tells_every_finding(spark, telemetry, tmp_path):
    from opslake.sources.telemetry import ContractError, read_telemetry

    back = telemetry([(60 * i, "database", {}) for i in (0, 2, 1)]).coalesce(1)
    back.write.parquet(str(tmp_path / "back.parquet"))
    with pytest.raises(ContractError, match="order"):
        read_telemetry(spark, str(tmp_path / "back.parquet"))
    back.orderBy("timestamp").coalesce(1).write.csv(str(tmp_path / "good.csv"), header=True)
    assert "ingest_seq" not in read_telemetry(spark, str(tmp_path / "good.csv")).columns
    back.write.csv(str(tmp_path / "back.csv"), header=True)
    with pytest.raises(ContractError, match="order"):
        read_telemetry(spark, str(tmp_path / "back.csv"))
    odd = telemetry([(60 * i, f"odd{i:02d}", {}) for i in range(30)]).coalesce(1)
    odd.write.parquet(str(tmp_path / "odd.parquet"))
    with pytest.raises(ContractError, match="29 more") as e:
        read_telemetry(spark, str(tmp_path / "odd.parquet"))
    assert e.value.findings.where("rule = 'unknown_service'").count() == 30


@pytest.fixture
def tiny_splits(spark):
    """Blocks of 64 bytes, so that a small file is read by many tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("64", "0"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


HOSTILE = [{"a": 'x,"],[{', "b": [1, [2, {"c": "\\"}]]}, "\\\",", ",", "", None, [], {}, -1.5e3, [[], [[","]]], {"": {"[": "}"}}, "line\nend, ]", "\u00e9,\u4e2d" * 40]


@pytest.mark.parametrize("mode", ["plain", "spread"])
def test_array_elements_of_hostile_files(spark, tiny_splits, tmp_path, mode):
    files = {"one": json.dumps(HOSTILE * 3), "wide": json.dumps(HOSTILE, indent=3, ensure_ascii=False) + "\n", "empty_array": " [ \n] ", "single": "[7]",
             "nothing": "", "object": '{"a": [1, 2], "b": 3}', "cut": '[1, {"a": 2', "two": "[1], [2]", "hole": "[1,,2]", "early": '["a", "b]'}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    got = {}
    for r in jsonarrays.array_elements(spark, str(tmp_path), mode).collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1][:-5], []).append(r)
    for name in ("one", "wide", "single"):
        rows = sorted(got[name], key=lambda r: r["ord"])
        assert [r["ord"] for r in rows] == list(range(len(rows))) and not any(r["bad_file"] or r["bad_element"] for r in rows)
        assert [json.loads(r["text"]) for r in rows] == json.loads(files[name])
    assert "empty_array" not in got and "nothing" not in got
    assert all(r["bad_file"] for name in ("object", "cut", "two", "early") for r in got[name])
    assert sorted((r["ord"], r["bad_file"], r["bad_element"]) for r in got["hole"]) == [(0, False, False), (1, False, True), (2, False, False)]


def test_large_incident_file_equals_whole_file(spark, tiny_splits, tmp_path, monkeypatch):
    path = tmp_path / "incidents.json"
    path.write_text(json.dumps([{**d, "incident_id": f"{d['incident_id']}-{k}", "description": 'a, "b" ]'} for k in range(20) for d in DOC]))
    whole = isource.read_incidents(spark, str(path))
    assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 20
    monkeypatch.setattr(isource, "WHOLE_FILE", 100)
    assert rows_of(isource.read_incidents(spark, str(path)), "ord") == rows_of(whole, "ord")
    path.write_text('{"not": "a list"' + " " * 200 + "}")
    with pytest.raises(ValueError):
        isource.read_incidents(spark, str(path))
