"""Registry of training and evaluation runs, and the inventory of stored artifacts."""
from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslake.schema import RUN


def new_run(model_name: str, metrics: dict[str, float], training_config: str = "{}", **fields) -> dict:
    defaults = {"model_version": "1.0.0", "feature_version": "1.0", "dataset_id": "unknown", "random_seed": None,
                "artifact_path": None, "run_id": str(uuid.uuid4()),
                "training_timestamp": datetime.now(timezone.utc).isoformat()}
    return {"model_name": model_name, "training_config": training_config, "metrics": metrics, **defaults, **fields}


def append_runs(runs: DataFrame, path: str) -> None:
    """Add runs to the registry table (JSON lines, one file set per append)."""
    runs.select(*[f.name for f in RUN.fields]).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All well-formed runs; malformed lines and lines without an id are skipped."""
    return spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(path).where(
        F.col("run_id").isNotNull() & F.col("model_name").isNotNull())


def find_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    found = read_runs(spark, path).where(F.col("run_id") == run_id)
    if found.isEmpty():
        raise FileNotFoundError(f"run {run_id} not found")
    return found


def list_runs(runs: DataFrame, model_name: str | None = None) -> DataFrame:
    kept = runs if model_name is None else runs.where(F.col("model_name") == model_name)
    return kept.orderBy(F.desc("training_timestamp"))


def compare_runs(runs: DataFrame, model_name: str, metric: str, descending: bool = True) -> DataFrame:
    """Runs of a model by one metric; runs without it come last either way, newer runs first among equals."""
    value = F.try_element_at("metrics", F.lit(metric))
    order = F.desc_nulls_last("metric_value") if descending else F.asc_nulls_last("metric_value")
    return runs.where(F.col("model_name") == model_name).withColumn("metric_value", value).orderBy(
        order, F.desc("training_timestamp"))


def artifact_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``name, size_bytes`` of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"))
