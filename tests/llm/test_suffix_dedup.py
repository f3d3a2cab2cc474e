"""Removed bytes against a plain search for repeated strings."""
import random
from collections import Counter

import numpy as np
import pytest

from opslake.llm import suffix_dedup as sd

SCHEMA = "doc_id bigint, text string, o1 string, kept string, row int, ranges int, n_bytes int, name string"


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if counts[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        out.append((i is None, i or 0, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


def made(spark, rows, length, parts=4):
    df = spark.createDataFrame([(*r, "a", "b", 1, 2, 3, "c") for r in rows], SCHEMA).repartition(parts)
    got = sd.remove_repeats(df, length)
    assert got.columns == ["doc_id", "o1", "row", "ranges", "name", "n_bytes", "n_removed", "n_spans", "removed", "kept"]
    found = got.collect()
    for r in found:
        assert r.n_removed == sum(x.b - x.a for x in r.removed) and r.n_spans == len(r.removed) and r.o1 == "a"
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdéf漢 ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (20, 33, 34, 36, 40, 60, 150)]
    rows = [None, "", "x", "a" * 199, "b" * 200, "c" * 200, "c" * 200, "d" * 900, "ab" * 300, "abc" * 300, "\x00" * 450]
    for _ in range(60):
        rows.append(prose(rng.randint(0, 40)) + "".join(rng.choice(shared)[rng.randint(0, 40):] + prose(rng.randint(0, 9)) for _ in range(rng.randint(0, 4))))
    base = prose(300)
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice("xyz")
        rows.append("".join(copy))
    rows += [base, base, base[100:900] * 2, base[:199] + "|" + base[199:700]]
    out = [(i if i % 10 else None, t) for i, t in enumerate(rows)]
    return out + [out[-1], out[-1], (None, base)]


@pytest.mark.parametrize("length,group", [(200, 2048), (200, 1), (104, 3)])
def test_repeats(spark, rows, monkeypatch, length, group):
    monkeypatch.setattr(sd, "GROUP_ROWS", group)
    assert made(spark, rows, length) == brute(rows, length)


def test_few(spark):
    assert made(spark, [], 200) == []
    rows = [(1, "q" * 5_000 + "r" * 300), (2, None), (3, "r" * 250)]
    assert made(spark, rows, 200, 1) == brute(rows, 200)


@pytest.mark.parametrize("chunk", [37, 1 << 21])
def test_every_string_is_represented_alike(chunk):
    rng = np.random.default_rng(2)
    body = rng.integers(97, 100, 500).astype(np.uint8)
    a, b = (np.concatenate((rng.integers(97, 123, n).astype(np.uint8), body, rng.integers(97, 123, 70).astype(np.uint8))) for n in (333, 41))
    reps = []
    for x, off in ((a, 333), (b, 41)):
        _, at, first, last = sd.sampled(x, np.array([len(x)]), 200, chunk)
        rep = {p: s for s, f, g in zip(at.tolist(), first.tolist(), last.tolist(), strict=True) for p in range(f, g + 1)}
        assert sorted(rep) == list(range(len(x) - 199)) and all(0 <= s - p < sd.COVER for p, s in rep.items())
        reps.append([rep[off + i] - off - i for i in range(301)])
    assert reps[0] == reps[1]
