"""Reading incident ground truth from JSON array documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from opslake.functions.scalars import utc_timestamp
from opslake.plans.sizing import settle
from opslake.schema import INCIDENT
from opslake.sources.jsonarrays import array_elements
from opslake.sources.telemetry import _exists, _file_system

#: Bytes of a file that one task may parse whole.
WHOLE_FILE = 16 << 20


def parse_incident_documents(documents: DataFrame, document: str, text: str) -> DataFrame:
    """Incidents of many JSON array documents: ``<document>, ord`` and the typed fields.

    ``ord`` is the position in the array, on which "last one wins" rests. A document that is no array gives a row with
    null ``ord`` and ``bad_document`` true, as an error that can be counted.
    """
    body = F.trim(F.col(text))
    is_array = F.coalesce(body.startswith("[") & F.from_json(body, "array<string>").isNotNull(), F.lit(False))
    parsed = documents.select(
        document, is_array.alias("_ok"),
        F.posexplode_outer(F.when(is_array, F.from_json(body, T.ArrayType(INCIDENT)))).alias("ord", "_i"))
    return parsed.where(~F.col("_ok") | F.col("ord").isNotNull()).select(
        document, F.col("ord").cast("bigint").alias("ord"), *_typed(), (~F.col("_ok")).alias("bad_document"))


def _typed() -> list[Column]:
    return [(utc_timestamp(F.col(f"_i.{f.name}")) if f.name.endswith("_time") else F.col(f"_i.{f.name}")).alias(f.name)
            for f in INCIDENT.fields]


def scan_incidents(spark: SparkSession, path: str, mode: str = "auto") -> DataFrame:
    """Incidents of all JSON array files at a path, of any size: ``file, ord``, the typed fields and ``bad_document``.

    A file is read by as many tasks as it has blocks. All rows of a file that is no array, or that has an element that is
    no JSON value, are marked ``bad_document``.
    """
    elements = array_elements(spark, path, mode)
    bad = elements.where("bad_file or bad_element").select("file").distinct().withColumn("bad_document", F.lit(True))
    return elements.join(bad, "file", "left").withColumn("_i", F.from_json("text", INCIDENT)).select(
        "file", "ord", *_typed(), F.col("bad_document").isNotNull().alias("bad_document"))


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incidents of one JSON array file; a missing file or a root that is no array is an error.

    A file above WHOLE_FILE bytes is read in pieces by many tasks, a smaller one at once; both give the same rows.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    fs, jpath = _file_system(spark, path)
    if fs.getContentSummary(jpath).getLength() > WHOLE_FILE:
        rows = settle(scan_incidents(spark, path), "incidents")
        if not rows.where("bad_document").isEmpty():
            raise ValueError(f"expected a list of incidents in {path}")
        return rows.drop("file", "bad_document")
    docs = spark.read.text(path, wholetext=True).select(F.lit(path).alias("document"), F.col("value").alias("text"))
    rows = parse_incident_documents(docs, "document", "text")
    if not rows.where("bad_document").isEmpty():
        raise ValueError(f"expected a list of incidents in {path}")
    return rows.drop("document", "bad_document")
