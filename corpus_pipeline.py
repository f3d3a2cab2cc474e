"""From raw documents to token ids: five stages, each over all that the one before it kept."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslake.llm import bpe, line_dedup, minhash_dedup, mixing, toxicity
from opslake.session import fresh_path

#: Lines in so many documents go; near copies are pairs of five-word shingle sets this similar (num / den).
MIN_DOCS, NUM, DEN = 10, 80, 100
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on what ``labels`` marks among them, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that many of them share; n_chars follows the text."""
    clean = line_dedup.drop_common_lines(docs, min_docs=MIN_DOCS).select(*docs.columns)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash_dedup.keep_one(docs, NUM, DEN)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, dealt to shards and shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes that they decode to."""
    ranks = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    back = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), *ranks).drop("text"), *ranks)
    return back.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources),
          ("tokens", to_tokens)]

#: The classifier, MinHash bands and draws of the mix have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
