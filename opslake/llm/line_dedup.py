"""Drop lines that many documents share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opslake.llm.rows import BLANKS, ascii_lower, shielded, text_of, without


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hash(key: Column) -> Column:
    """128 bits of a key as two longs; the second hash starts from another state."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def _hashes(text: Column, min_chars: int) -> Column:
    """Hash of each line's key, null for keys too short to be dropped."""
    keys = F.transform(_lines(text), _key)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, _hash(k)))


def common_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Hashes (a, b) of the line keys found in at least ``min_docs`` documents, with their document count.

    Each row is one document; a key counts once per row. Counting is combined before the shuffle, so a line that nearly
    every document has costs one row per task.
    """
    h = F.explode(F.array_compact(F.array_distinct(_hashes(text_of(text), min_chars)))).alias("_h")
    return (docs.select(h).select("_h.a", "_h.b").groupBy("a", "b").agg(F.count("*").alias("n_docs"))
            .where(F.col("n_docs") >= min_docs))


@shielded
def drop_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10,
                      min_chars: int = 1) -> DataFrame:
    """Explode normalised lines, hash, count documents per hash, drop lines over the threshold, reassemble by position.

    A text splits at ``\\n``; null or empty text is one empty line. A line's key is the line with ASCII white space
    stripped at both ends and A-Z lower-cased; keys shorter than ``min_chars`` code points always stay. Lines keep their
    order and are joined by ``\\n``. A document that loses all lines becomes the empty string. Every row is a document:
    repeated rows count separately, whatever their ids. Returns the input's columns with ``text`` replaced (never null)
    and ``n_lines`` and ``n_dropped`` added; input columns of those names are replaced. No rows give no rows.

    The occurrences that meet the common keys carry a row's identity and one hash, not its text; what comes back per
    document is the list of its own dropped keys, so no group grows with the number of documents that share a line.
    """
    ids = docs.select(F.col(doc_id).alias("_id"), F.explode(F.array_compact(F.array_distinct(
        _hashes(text_of(text), min_chars)))).alias("_h")).select("_id", "_h.a", "_h.b")
    hit = ids.join(common_lines(docs, text, min_docs, min_chars).select("a", "b"), ["a", "b"], "left_semi")
    gone = hit.groupBy("_id").agg(F.collect_set(F.struct("a", "b")).alias("_gone"))
    joined = without(docs, "n_lines", "n_dropped").join(gone, F.col(doc_id).eqNullSafe(F.col("_id")), "left").drop("_id")
    pairs = F.arrays_zip(_lines(text_of(text)).alias("line"), _hashes(text_of(text), min_chars).alias("h"))
    kept = F.filter(pairs, lambda p: p["h"].isNull() | ~F.array_contains(F.col("_gone"), p["h"]))
    clean = F.when(F.col("_gone").isNull(), text_of(text)).otherwise(F.array_join(F.transform(kept, lambda p: p["line"]), "\n"))
    n_kept = F.when(F.col("_gone").isNull(), F.size(_lines(text_of(text)))).otherwise(F.size(kept))
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = joined.select(*[F.col(c) for c in order if c != text], clean.alias("_clean"),
                        F.size(_lines(text_of(text))).cast("long").alias("n_lines"), n_kept.cast("long").alias("_kept"))
    return out.select(*[F.col("_clean").alias(c) if c == text else F.col(c) for c in order], "n_lines",
                      (F.col("n_lines") - F.col("_kept")).alias("n_dropped"))
