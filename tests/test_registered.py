"""Registered queries against their SQL on an independent engine, at the smallest scale.

OPSLAKE_ORACLE=all runs every query; the default is one per family.
"""
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SOME = ("telemetry_rollup", "incident_scan", "incident_scan_large", "clean_report",
        "incident_labels_many", "horizon_labels", "features_all",
        "zscore_anomalies_spread", "rca_rank", "evidence_signals", "anomaly_metrics", "drift_verdicts", "topology_depth",
        "stream_rollup", "stream_zscore_state")
NAMES = sorted(entry.ORACLE) if os.environ.get("OPSLAKE_ORACLE") == "all" else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
    df = df.astype(object).where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = _plain(entry.queries()[name](spark, SF).toPandas()), _plain(duck.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        assert got[c].tolist() == want[c].tolist(), c


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["timestamp", "service", "anomaly_score", "is_anomaly", "anomalous_metrics"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.QUERIES) <= set(entry.queries())
