"""Trailing z-score, forest scores, labels and drift on micro-batches."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from opslake.operators.drift import DriftConfig, feature_drift, reference_counts
from opslake.operators.iforest import ForestModel, predict_forest
from opslake.operators.labels import incident_labels
from opslake.operators.zscore import ZScoreConfig, zscore_anomalies
from opslake.schema import numeric_columns
from opslake.session import fresh_path
from opslake.streaming.run import run_batches


class TrailingZScore:
    """Z-scores per micro-batch with the last rows of each service carried over in a table.

    A batch is scored together with the carried rows by the batch operator, so a busy service is spread over slices there
    too. Every batch writes its own folder of scores and of carried rows and reads the folder of the batch before: a
    replayed batch overwrites its own output with the same rows. Rows not newer than what a service has already seen in an
    earlier batch are late; they are counted and not scored.
    """

    def __init__(self, root: str, config: ZScoreConfig = ZScoreConfig(), mode: str = "auto"):
        self.root, self.config, self.mode = root.rstrip("/"), config, mode

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cols = ["timestamp", "service", *[m for m in self.config.metrics if m in batch.columns]]
        fresh = batch.select(*cols).persist()
        try:
            if batch_id > 0:
                carried = spark.read.schema(fresh.schema).parquet(f"{self.root}/carry/{batch_id - 1}")
                seen = carried.groupBy("service").agg(F.max("timestamp").alias("_seen"))
                marked = fresh.join(seen, "service", "left")
                on_time = F.col("_seen").isNull() | (F.col("timestamp") > F.col("_seen"))
                late = marked.where(~on_time).select(*cols)
                new = marked.where(on_time).select(*cols)
            else:
                carried, late, new = fresh.limit(0), fresh.limit(0), fresh
            both = carried.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
            scored = zscore_anomalies(both.drop("_new"), self.config, self.mode)
            new_keys = both.where("_new").select("timestamp", "service")
            scored.join(new_keys, ["timestamp", "service"], "left_semi").write.mode("overwrite").parquet(
                f"{self.root}/scores/{batch_id}")
            late.write.mode("overwrite").parquet(f"{self.root}/late/{batch_id}")
            newest = Window.partitionBy("service").orderBy(F.desc("timestamp"))
            # row_number <= k on a window is cut down map-side before the exchange.
            both.drop("_new").withColumn("_back", F.row_number().over(newest)).where(
                F.col("_back") <= self.config.window).drop("_back").write.mode("overwrite").parquet(
                f"{self.root}/carry/{batch_id}")
        finally:
            fresh.unpersist()


def stream_zscores(telemetry: DataFrame, config: ZScoreConfig = ZScoreConfig(), mode: str = "auto",
                   root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run over the available data; returns (scores, late rows)."""
    spark = telemetry.sparkSession
    root = root or fresh_path(spark, "zscore")
    run_batches(telemetry, TrailingZScore(root, config, mode))
    reader = spark.read.option("recursiveFileLookup", True)
    return reader.parquet(f"{root}/scores"), reader.parquet(f"{root}/late")


def forest_batches(model: ForestModel, out: str) -> Callable[[DataFrame, int], None]:
    """Score every micro-batch with a fitted forest; scoring has no state, so late rows need no care."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        predict_forest(batch, model).write.mode("overwrite").parquet(f"{out}/{batch_id}")

    return handle


def label_batches(incidents: DataFrame, out: str) -> Callable[[DataFrame, int], None]:
    """Join every micro-batch with the incident table as it stands."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        incident_labels(batch, incidents).write.mode("overwrite").parquet(f"{out}/{batch_id}")

    return handle


def drift_batches(reference: DataFrame, out: str, features: list[str] | None = None,
                  config: DriftConfig = DriftConfig()) -> Callable[[DataFrame, int], None]:
    """Compare every micro-batch that has rows with a fixed reference, which is counted once."""
    counted = reference_counts(reference, [c for c in features or numeric_columns(reference) if c in reference.columns])

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        feature_drift(reference, batch, features, config, counted=counted).withColumn("batch_id", F.lit(batch_id)).write.mode(
            "overwrite").parquet(f"{out}/{batch_id}")

    return handle
