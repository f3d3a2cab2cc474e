"""Phrases and their scores against a plain count of all n-grams."""
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from opslake.llm import collocations as co

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int, words int, shard string"


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c < "\x80" else c for c in text or ""))]


def brute(rows, least, longest, covered, top):
    counts, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for ws in pieces(text):
            n[lang] += len(ws)
            counts.update((lang, tuple(ws[i:i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    cand = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = {}
    for (lang, p), a in cand.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside.get((lang, p[i:j]), 0), a)
    out = []
    for lang in n:
        found = []
        for (g, p), a in cand.items():
            if g == lang and 100 * inside.get((g, p), 0) < covered * a:
                score, _, l, r = min((1000 * a * n[g] // (counts[g, p[:k]] * counts[g, p[k:]]), k, counts[g, p[:k]], counts[g, p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), l, r))
        out += [(lang, k, p, -a, l, r, n[lang], -s) for k, (s, a, _, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made(spark, rows, **args):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in co.collocations(df, **args).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "of", "Ba", "ba", "é\x85x", "x\x1cy", " ", "漢", "\x00", "it's"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", ".\n", "!", "\t", "\r"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["a a a a a a a a", "one two three four five six " * 30, None, "", " \t.,", "the of the " * 3000]
    langs = ["en", "fr", None, "und"]
    out = [(i if i % 9 else None, t, rng.choice(langs)) for i, t in enumerate(texts)]
    return out + out[:20]


@pytest.mark.parametrize("shard,least,covered,top,lists", [(64, 5, 100, 2000, 10**6), (1 << 20, 20, 90, 7, 0), (700, 1, 60, None, 0)])
def test_collocations(spark, rows, monkeypatch, shard, least, covered, top, lists):
    monkeypatch.setattr(co, "LIST_ROWS", lists)
    monkeypatch.setattr(co, "SHARD_WORDS", shard)
    some = rows if least > 1 else rows[:60]
    got = made(spark, some, min_count=least, max_words=5, covered=covered, top=top)
    assert got == brute(some, least, 5, covered, top) and got


def test_nothing(spark):
    assert made(spark, [(1, "a b", "en"), (2, None, None)], min_count=3) == []
    df = spark.createDataFrame([], SCHEMA)
    assert co.collocations(df).collect() == []


@pytest.mark.parametrize("depth", [3, 4, 300])
def test_index_extends_both_ways(depth):
    rng = np.random.default_rng(1)
    x = np.append(rng.integers(0, 6, 400), 0).astype(np.int32)
    text = x.tolist()
    before, after = co.FMIndex(co.FMIndex.transform(x, depth)), co.FMIndex(co.FMIndex.transform(np.append(x[-2::-1], 0).astype(np.int32), depth))
    grams = sorted({tuple(text[i:i + 2]) for i in range(len(text) - 1) if 0 not in text[i:i + 2]})
    table = np.array(grams, np.int32)
    for index, words, longer in ((before, [table[:, 1], table[:, 0]], lambda g, w: (w, *g)), (after, [table[:, 0], table[:, 1]], lambda g, w: (*g, w))):
        phrase, word, count = index.extensions(*index.find(words))
        got = {longer(grams[p], w): c for p, w, c in zip(phrase.tolist(), word.tolist(), count.tolist())}
        want = Counter(tuple(text[i:i + 3]) for i in range(len(text) - 2) if 0 not in text[i:i + 3])
        assert got == want


@pytest.mark.parametrize("shards", [1, 2, 40])
def test_counts_of_shards_leave_a_task_summed(monkeypatch, shards):
    """Shards that say the same give one row per phrase, however many rows they have in all."""
    names = ["shard", "lang", "phrase", "n"]

    def longer(batch, i):
        for lang in ("en", None):
            yield pa.RecordBatch.from_arrays([pa.array([i] * 50, pa.int64()), pa.array([lang] * 50, pa.string()), pa.array([f"w{k}" for k in range(50)]),
                                              pa.array(range(1, 51), pa.int64())], names)

    monkeypatch.setattr(co, "_longer", longer)
    monkeypatch.setattr(co, "HELD_ROWS", 120)
    batch = pa.RecordBatch.from_arrays([pa.array(range(shards))], ["shard"])
    got = [r for b in co._grow_and_sum(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["lang"] or "", r["phrase"], r["n"]) for r in got) == sorted((lang, f"w{k}", (k + 1) * shards) for lang in ("en", "") for k in range(50))
    monkeypatch.setattr(co, "HELD_ROWS", 30)
    got = [r for b in co._grow_and_sum(iter([batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in got) == 2 * sum(range(51)) * shards


def test_many_frequent_phrases_are_looked_up(spark, monkeypatch, tmp_path):
    """Over 300,000 frequent pairs: no shard counts its words and pairs again for a join with them."""
    plain, seen = co._words_and_pairs, str(tmp_path)

    def noted(batches):
        import uuid

        for batch in batches:
            open(f"{seen}/{uuid.uuid4().hex}-{batch.num_rows}", "w").close()
            yield from plain(iter([batch]))

    monkeypatch.setattr(co, "_words_and_pairs", noted)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 3000)) for _ in range(112)]
    phrases, _ = co.frequent_phrases(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(4), 1, 3)
    got = {}
    for r in phrases.groupBy("size", "f").count().collect():
        n, total = got.get(r["size"], (0, 0))
        got[r["size"]] = n + r["count"], total + r["count"] * r["f"]
    of = [Counter(tuple(w[i:i + k]) for w in map(str.split, texts) for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
    assert got == {k: (len(c), sum(c.values())) for k, c in enumerate(of, 1)} and got[2][0] > 300_000
    assert sum(int(p.name.split("-")[1]) for p in tmp_path.iterdir()) == 4


def test_digests_of_phrases():
    words = [b"a", b"ab", b"ba", "漢".encode(), b"a" * 5000, b"a" * 5001, b"it's"]
    array = pa.array(words, pa.binary()).cast(pa.string())
    one = co._word_digests(array)
    assert len(set(one.tolist())) == len(words) and (co._word_digests(array.slice(2, 3)) == one[2:5]).all()
    pairs = [(i, j) for i in range(7) for j in range(7)]
    text = pa.array([f"{array[i]} {array[j]}" for i, j in pairs])
    made = {lang: co._phrase_digests(lang, [one[[p[0] for p in pairs]], one[[p[1] for p in pairs]]]) for lang in ("en", "")}
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 49), text], ["lang", "phrase"])
    [row] = [r["digests"] for b in co._digests(iter([batch])) for r in b.to_pylist()]
    assert (np.frombuffer(row, np.uint64) == made["en"]).all()
    assert len({*made["en"].tolist(), *made[""].tolist()}) == 98
    assert co._among(made["en"], np.sort(made["en"][:9])).tolist() == [True] * 9 + [False] * 40
    assert not co._among(made[""], made["en"][:0]).any()
