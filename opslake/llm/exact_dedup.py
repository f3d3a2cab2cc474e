"""Exact duplicates by a persistent index of digests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opslake.llm.rows import text_of
from opslake.session import fresh_path

#: A digest that holds more than this share of a batch's rows is joined by broadcast: there can be at most 1 / share.
HOT_SHARE = 0.001


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A table of digests, bucketed and sorted by digest, to which each new batch appends what it did not hold.

    The table lies at ``path`` and is registered under ``name``, so it outlives the session: opening it again with the
    same path goes on where the last batch ended. Rows: digest, keep_id (the smallest id of the batch that brought it)
    and batch.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, batch BIGINT) USING parquet "
                      f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.read.table(self.name)

    def append(self, firsts: DataFrame) -> None:
        """Add the digests of a batch that the index lacks; ``firsts`` has each digest of the batch once, with its smallest id.

        ``firsts`` should be a written table: Spark moves an anti-join below an aggregate, and would shuffle every row of a hot digest.
        """
        batch = (self.table().agg(F.max("batch")).first()[0] or 0) + 1
        new = firsts.select("digest", "keep_id").join(self.table().hint("merge"), "digest", "left_anti")
        (new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .select("digest", "keep_id", F.lit(batch).cast("long").alias("batch"))
         .write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))


def new_index(spark: SparkSession) -> DigestIndex:
    path = fresh_path(spark, "digests")
    return DigestIndex(spark, path, "digests_" + path.rsplit("-", 1)[-1], max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Mark the documents whose normalised text an earlier or smaller document already has.

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty. Of equal
    texts in one batch the row with the smallest id stays; of a text that the index already holds, the row that brought
    it. Rows with a null id never stay beside a row with an id, and a group of null ids only has keep_id null and keeps
    them all, as nothing tells them apart; rows repeated under one id share its fate. Returns one row per document:
    doc_id, keep_id, group_size (rows of this batch with the same text), kept and text_sha256.

    One pass over the texts writes ids and digests; all else works on these. Digests with a hot share of the rows are
    joined by broadcast (their number is bounded by the share), all others by sort-merge.
    """
    spark = docs.sparkSession
    index = index or new_index(spark)
    path = fresh_path(spark, "batch")
    docs.select(F.col(doc_id).alias("doc_id"), digest(text_of(text)).alias("digest")).write.parquet(path)
    batch = spark.read.schema("doc_id bigint, digest binary").parquet(path)
    sizes = fresh_path(spark, "sizes")
    batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).write.parquet(sizes)
    groups = spark.read.schema("digest binary, keep_id bigint, group_size bigint").parquet(sizes)
    index.append(groups)
    n = groups.agg(F.sum("group_size")).first()[0] or 0
    known = index.table().select("digest", "keep_id").join(groups.drop("keep_id").hint("merge"), "digest")
    hot = F.broadcast(known.where(F.col("group_size") > max(1, n * HOT_SHARE)))
    named = batch.join(hot, "digest", "left")
    rest = named.where(F.col("group_size").isNull()).select("digest", "doc_id").join(
        known.where(F.col("group_size") <= max(1, n * HOT_SHARE)).hint("merge"), "digest")
    both = named.where(F.col("group_size").isNotNull()).select("digest", "doc_id", "keep_id", "group_size").unionByName(
        rest.select("digest", "doc_id", "keep_id", "group_size"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))
