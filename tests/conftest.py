import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from opslake.schema import METRICS, TELEMETRY  # noqa: E402
from opslake.session import get_session  # noqa: E402

DEFAULTS = {"cpu_usage_pct": 20.0, "memory_usage_pct": 40.0, "disk_usage_pct": 30.0, "network_in_mbps": 5.0,
            "network_out_mbps": 5.0, "request_rate_rps": 50.0, "latency_ms": 20.0, "error_rate": 0.002,
            "active_connections": 30, "connection_utilization": 0.3}
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", "opslake-tests", shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="session")
def telemetry(spark):
    """Make telemetry from (seconds, service, {metric: value})."""

    def make(rows):
        data = [(at(s), svc, *[{**DEFAULTS, **over}[m] for m in METRICS]) for s, svc, over in rows]
        return spark.createDataFrame(data, TELEMETRY)

    return make


@pytest.fixture(scope="session")
def incidents(spark):
    """Make incidents from dicts; times are seconds after the start."""
    schema = ("ord bigint, incident_id string, incident_type string, root_cause_service string, "
              "affected_services array<string>, start_time timestamp_ntz, detection_time timestamp_ntz, "
              "end_time timestamp_ntz, severity string")

    def make(*rows):
        data = [(i, r.get("id", f"INC-{i}"), "database_connection_saturation", r.get("root"), r.get("affected"),
                 at(r["start"]), at(r["start"]), at(r["end"]), r.get("severity", "high")) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, schema)

    return make


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
