"""Running a stream to the end of the available data and reading its result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from opslake.session import fresh_path
from opslake.sources.telemetry import is_single_file

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream a Parquet table: a folder of files, or a single file picked out of its folder by name."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_single_file(spark, path):
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep large state on disk rather than on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def run_to_table(stream: DataFrame, mode: str = "append", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run with ``availableNow`` into a Parquet table in the shared folder and read it back."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    out = out or fresh_path(spark, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", checkpoint or fresh_path(spark, "offsets")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Run ``handle(batch, batch_id)`` on every micro-batch until the available data is used up."""
    use_rocksdb(stream.sparkSession)
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, "offsets"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
