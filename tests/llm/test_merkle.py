"""The manifest against a plain tree built in memory."""
import hashlib

import pytest
from pyspark.sql import functions as F

from opslake.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields):
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(level):
    """Root of a list of digests and, per leaf, its siblings (left, right) from the leaf upwards."""
    paths, owners = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        runs = [range(i, min(i + 3, len(level))) for i in range(0, len(level), 3)]
        for run in runs:
            for i in run:
                for leaf in owners[i]:
                    paths[leaf].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        owners = [[leaf for i in run for leaf in owners[i]] for run in runs]
        level = [digest("".join(level[i] for i in run)) for run in runs]
    return level[0], paths


def brute(rows):
    """{row number: (leaf, subroot, root, proof)} for rows (id, text, lang, source)."""
    leaves = [leaf_of(*r) for r in rows]
    groups = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i])):
        groups.setdefault(rows[i][3], []).append(i)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    subs = {n: climb([leaves[i] for i in groups[n]]) for n in names}
    root, upper = climb([subs[n][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for j, i in enumerate(groups[n]):
            proof = "".join(a + b for a, b in subs[n][1][j] + upper[k])
            out.append((leaves[i], subs[n][0], root, digest(proof)))
    return sorted(out)


def made(df):
    found = merkle.manifest(df, merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "text", "lang", "source")]))
    hexed = [merkle.text_of_digest(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    rows = found.select(*hexed, F.sha2(merkle.text_of_digest(merkle.siblings(F.col("path"))), 256).alias("proof"),
                        (merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in rows)
    return sorted(tuple(r)[:4] for r in rows)


SCHEMA = "doc_id bigint, text string, lang string, source string, path string, root int, n int, pos int, `at` int, `group` string, kept string, block int, d0 string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "g", "k", 5, "d") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("block_levels", [1, 6])
def test_trees(spark, monkeypatch, block_levels):
    monkeypatch.setattr(merkle, "LEVELS", block_levels)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** block_levels)
    rows = [(i, f"text {i}\né" if i % 7 else None, "en", None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 13}") for i in range(150)]
    rows += [(None, "a", None, "hot"), (None, "b", None, "hot"), (5, "text 5\né", "en", "hot"), (5, "text 5\né", "en", "hot"), (7, "", "en", "\U0001f600"), (7, "x" * 300_000, "en", "￮")]
    assert made(frame(spark, rows)) == brute(rows)


def test_many_blocks(spark):
    rows = [(i, None, None, "one") for i in range(2_200)]
    assert made(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("rows", [[(1, "a", "en", "s")], [(1, "a", "en", None), (2, "b", "en", "s")]])
def test_few(spark, rows):
    assert made(frame(spark, rows)) == brute(rows)


def test_empty_and_tampering(spark):
    assert made(frame(spark, []).limit(0)) == []
    rows = [(i, f"line\n{i}", "en", "s") for i in range(30)]
    leaf = [F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")]
    cut = merkle.leaf_digest(leaf[0], F.when(F.col("doc_id") == 4, F.translate("text", "\n", "")).otherwise(F.col("text")), *leaf[2:])
    found = merkle.manifest(frame(spark, rows), merkle.leaf_digest(*leaf), keep={"doc_id": F.col("doc_id"), "seen": cut, "root": F.lit("taken")})
    bad = found.where(merkle.folded(F.col("seen"), F.col("path")) != F.col("root")).select("doc_id").collect()
    assert [r[0] for r in bad] == [4]
