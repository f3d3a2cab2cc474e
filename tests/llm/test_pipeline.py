"""The pipeline's stages over a small corpus."""
import hashlib
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from opslake.llm import bpe  # noqa: E402


def make(spark, folder):
    import random

    rnd = random.Random(8)
    word = lambda: rnd.choice("river tree stone cloud winter green paper little house walk".split()) + str(rnd.randrange(300))
    rows, labels = [], []
    for i in range(400):
        body = [" ".join(word() for _ in range(30)) for _ in range(3)]
        toxic = i % 4 == 0
        if toxic:
            body[1] += " vilewort vilewort"
        if i % 10 == 5 and not toxic:
            body.append("Shared line of the site")
        rows.append([i, "\n".join(body), "en", f"s{i % 4}", 0])
        labels.append((i, 1, int(toxic)))
    for i in range(20):
        copy = rows[4 * i + 1][1].split(" ")
        copy[5] = "changed"
        rows.append([400 + i, " ".join(copy), "en", "s1", 0])
    for r in rows:
        r[4] = len(r[1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r for r in rows}


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    clean = {r["doc_id"] for r in out["toxicity"].collect()}
    assert clean == {i for i, r in rows.items() if "vilewort" not in r[1]}
    lined = {r["doc_id"]: r for r in out["line_dedup"].collect()}
    assert set(lined) == clean and all("Shared line" not in r["text"] and r["n_chars"] == len(r["text"]) for r in lined.values())
    assert all(lined[i]["text"] == rows[i][1].replace("\nShared line of the site", "") for i in clean)
    near = {r["doc_id"] for r in out["near_dedup"].collect()}
    assert near == {i for i in clean if i < 400}
    mixed = Counter(r["doc_id"] for r in out["mixing"].collect())
    assert set(mixed) <= near and max(mixed.values()) <= 3
    enc = bpe._encoding(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY), corpus_pipeline.public_tokenizers.PATTERN)
    tokens = out["tokens"].collect()
    assert Counter(r["doc_id"] for r in tokens) == mixed
    for r in tokens:
        assert r["ids"] == enc.encode_ordinary(lined[r["doc_id"]]["text"]) and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lined[r["doc_id"]]["text"].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, tmp_path):
    make(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and got.count() > 200
