"""Times the headline queries and prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from opslake.session import get_session  # noqa: E402
from workloads.queries import QUERIES  # noqa: E402

HEADLINE = (
    "telemetry_rollup", "telemetry_summary", "latest_telemetry", "clean_telemetry", "incident_labels", "features_all",
    "zscore_anomalies", "zscore_anomalies_spread", "iforest_anomalies", "anomaly_metrics", "rca_rank", "rca_explanations",
    "drift_verdicts", "model_health",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", "opslake-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                        driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flagged_anomalies"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    taken = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken,
                      "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
