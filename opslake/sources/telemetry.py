"""Reading, writing and summarising telemetry tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from opslake.functions.scalars import utc_time
from opslake.plans.sizing import broadcast_if_small
from opslake.schema import METRICS, TELEMETRY
from opslake.session import fresh_path

ROWS_PER_FILE_RANGE = 1 << 40


class ContractError(ValueError):
    """A table breaks the contract; ``findings`` is the written table of all errors."""

    def __init__(self, message: str, findings: DataFrame):
        super().__init__(message)
        self.findings = findings


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def read_telemetry(spark: SparkSession, path: str, validate: bool = True, parse_timestamps: bool = False,
                   with_seq: bool = False) -> DataFrame:
    """Read a ``.parquet``/``.pq`` or ``.csv`` path; a missing path or another suffix is an error.

    CSV gets a fixed schema, with timestamps as text; no inference pass. ``validate`` runs the contract rules and raises
    with their messages, of each rule one message that counts its findings; all of them lie in the table ``findings``
    of the error. The order of the rows, by file and place in it, is checked too. ``with_seq`` keeps it as ``ingest_seq``.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    suffix = _suffix(path)
    if suffix in (".parquet", ".pq"):
        df = spark.read.parquet(path)
    elif suffix == ".csv":
        text = T.StructType([T.StructField("timestamp", T.StringType()), *TELEMETRY.fields[1:]])
        df = spark.read.schema(_csv_schema(spark, path, text)).csv(path, header=True)
    else:
        raise ValueError(f"unsupported file format {suffix!r}, expected .parquet or .csv")
    if with_seq or validate:
        df = with_ingest_seq(df, suffix == ".csv")
    if validate:
        from opslake.operators.validate import validate_order, validate_rules

        found = validate_rules(df.drop("ingest_seq"))
        if "service" in df.columns and "timestamp" in df.columns:
            found = found.unionByName(validate_order(df, "ingest_seq"))
        path = fresh_path(spark, "findings")
        found.where("severity = 'error'").write.parquet(path)
        errors = spark.read.schema(found.schema).parquet(path)
        per_rule = errors.groupBy("rule").agg(F.count("*").alias("n"), F.min("message").alias("first")).orderBy("rule").collect()
        if per_rule:
            told = [r["first"] + (f" and {r['n'] - 1} more findings of this rule" if r["n"] > 1 else "") for r in per_rule]
            raise ContractError("telemetry contract violated: " + "; ".join(told), errors)
    if not with_seq:
        df = df.drop("ingest_seq")
    return df.withColumn("timestamp", utc_time(df, "timestamp")) if parse_timestamps else df


def _csv_schema(spark: SparkSession, path: str, wanted: T.StructType) -> T.StructType:
    """The fixed types in the order of the file's header; columns we do not know stay text."""
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType for f in wanted.fields}
    return T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _file_system(spark, path)
    return fs.exists(jpath)


def is_single_file(spark: SparkSession, path: str) -> bool:
    fs, jpath = _file_system(spark, path)
    return fs.exists(jpath) and fs.getFileStatus(jpath).isFile()


def with_ingest_seq(df: DataFrame, text: bool = False) -> DataFrame:
    """``ingest_seq``: number of the file by path times 2**40 plus row index in the file. Only file names are grouped.

    Text files know no row index: there the blocks that were read are numbered by file and offset, and rows by the order
    in which their task reads them.
    """
    block = F.col("_metadata.file_block_start") if text else F.lit(0).cast("bigint")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) if text else F.col("_metadata.row_index")
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), block.alias("_block"), row.alias("_row"))
    blocks = rows.select("_file", "_block").distinct()
    numbered = blocks.withColumn("_no", F.row_number().over(Window.orderBy("_file", "_block")) - 1)
    return rows.join(broadcast_if_small(numbered), ["_file", "_block"]).withColumn(
        "ingest_seq", F.col("_no").cast("bigint") * F.lit(ROWS_PER_FILE_RANGE) + F.col("_row")).drop("_file", "_block", "_row", "_no")


def write_by_date(df: DataFrame, path: str) -> None:
    """Overwrite a Parquet table partitioned by date; used for clean telemetry and for features.

    Rows are clustered by date and service range before writing, so a date does not end up in one file per task, nor a
    busy date in one task; rows of a file are in the order of time and service.
    """
    (
        df.withColumn("date", F.to_date("timestamp")).repartitionByRange("date", "service", "timestamp")
        .sortWithinPartitions("date", "timestamp", "service").write.mode("overwrite").partitionBy("date").parquet(path)
    )


def latest(df: DataFrame, limit: int = 500) -> DataFrame:
    """Newest rows first, service as tie-break; runs as a top-k, not a full sort."""
    return df.orderBy(F.desc("timestamp"), "service").limit(limit)


def earliest(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy("timestamp", "service").limit(limit)


def summary(df: DataFrame) -> DataFrame:
    """Row count, sorted service names and time range in one pass; the set holds one entry per service."""
    return df.agg(
        F.count(F.lit(1)).alias("record_count"), F.array_sort(F.collect_set("service")).alias("services"),
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))


def metric_columns(df: DataFrame) -> list[str]:
    return [m for m in METRICS if m in df.columns]
