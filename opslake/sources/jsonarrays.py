"""Elements of JSON array files that many tasks read together."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opslake.plans.ordering import running_totals
from opslake.plans.sizing import settle


def _occurrences(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("bigint")


def _depth(outside: Column) -> Column:
    return _occurrences(outside, "[{") - _occurrences(outside, "]}")


def array_elements(spark: SparkSession, path: str, mode: str = "auto") -> DataFrame:
    """``file, ord, text, bad_file, bad_element`` of all JSON array files at ``path``: one row per element, in file order from 0.

    Files are read in pieces between commas, so that a file of one line is split like any other. A piece counts its
    quotes and, for both cases of starting inside a string or outside, how far its brackets go down or up. Running
    totals over the pieces of a file (by block and place in the block) then tell of each comma whether it lies in a
    string and how deep: those at depth one part elements. Only the pieces of one element come together in a group.

    ``bad_file`` marks the rows of a file that is no array, whose elements are not to be trusted; ``bad_element`` one that is
    no JSON value. An empty array gives no rows, an empty file none either. Escaped quotes, brackets and commas in strings
    and line ends anywhere are allowed. Compressed files are read by one task each.
    """
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    # A comma never follows a backslash, so an escape lies within its piece.
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    strings = r'"[^"]*("|\z)'
    rest = F.regexp_replace(bare, r'^[^"]*("|\z)', "")
    pieces = raw.select("*", _occurrences(bare, '"').alias("quotes"), _depth(F.regexp_replace(bare, strings, "")).alias("outside"),
                        _depth(F.regexp_replace(rest, strings, "")).alias("inside"), F.lit(1).cast("bigint").alias("one"))
    order = ["block", "place"]
    quoted = running_totals(pieces, ["file"], order, {"q": "quotes", "pos": "one"}, mode).select(
        "file", "block", "place", "value", "q", "pos", "pos_total",
        F.when((F.col("q") - F.col("quotes")) % 2 == 1, F.col("inside")).otherwise(F.col("outside")).alias("down"))
    deep = running_totals(quoted, ["file"], order, {"depth": "down"}, mode).drop("depth_total")
    last, open_ = F.col("pos") == F.col("pos_total"), F.col("q") % 2 == 1
    parted = deep.withColumn("parts", (~last & ~open_ & (F.col("depth") == 1)).cast("bigint"))
    numbered = running_totals(parted, ["file"], order, {"upto": "parts"}, mode)
    head, tail = r"^\s*\[", r"\]\s*\z"
    body = F.when(F.col("pos") == 1, F.regexp_replace("value", head, "")).otherwise(F.col("value"))
    body = F.when(last, F.regexp_replace(body, tail, "")).otherwise(body)
    wrong = (((F.col("pos") == 1) & ~F.col("value").rlike(head)) | F.when(last, ~F.col("value").rlike(tail) | open_ | (F.col("depth") != 0)).otherwise(
        ~open_ & (F.col("depth") < 1)))
    rows = numbered.select("file", (F.col("upto") - F.col("parts")).alias("ord"), F.col("upto_total").alias("commas"), "pos", body.alias("body"), wrong.alias("wrong"))
    elements = settle(rows.groupBy("file", "ord").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda p: p["body"]), ",").alias("text"),
        F.max("commas").alias("commas"), F.max("wrong").alias("wrong")), "elements")
    bad = elements.where("wrong").select("file").distinct().withColumn("bad", F.lit(True))
    blank = F.trim(F.regexp_replace("text", r"\s", "")) == ""
    return elements.join(bad, "file", "left").where(F.col("bad").isNotNull() | ~(blank & (F.col("commas") == 0))).select(
        "file", "ord", "text", F.col("bad").isNotNull().alias("bad_file"), F.expr("try_parse_json(text)").isNull().alias("bad_element"))
