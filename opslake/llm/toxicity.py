"""Toxicity by weak supervision: voters, a label model over their votes, a linear classifier on its posteriors."""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from opslake.llm.minhash_dedup import Shingler
from opslake.llm.rows import per_text, remainder, text_slices

#: Bounds of the fit: labelled rows, voters, features of the classifier.
SAMPLE_ROWS, MAX_VOTERS, MAX_FEATURES = 20_000, 400, 3_000
#: Labelled documents a word or pattern must occur in.
LEAST_DOCS = 5
#: Lengths of the word beginnings that pattern voters look for.
BEGINNINGS = (4, 5, 6)
#: Evidence that a feature tells the classes apart (likelihood ratio statistic) below which it is left out as chance, and
#: log-odds from which it may vote.
LEAST_EVIDENCE, LEAST_ODDS = 25.0, 3.0
#: Letters by which words and beginnings count as one family, of which the most telling votes.
FAMILY = 4
#: Excess of joint votes, as a correlation given the class, from which voters count as one.
CORRELATED = 0.8
#: Words whose features a worker remembers.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[str, ...]:
    """A lexicon entry and the beginnings of a word, marked by a trailing star."""
    return (word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n))


def features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


@dataclass
class ToxicityModel:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self):
        known: dict[str, tuple[str, ...]] = {}
        weights = self.weights

        def score(text: str) -> float:
            nonlocal known
            hits: set[str] = set()
            for w in set(_WORD.findall(text.lower())):
                f = known.get(w)
                if f is None:
                    f = tuple(x for x in word_features(w) if x in weights)
                    if len(known) >= REMEMBERED:
                        known = {}
                    if len(w) <= 64:
                        known[w] = f
                hits.update(f)
            z = self.bias + sum(map(weights.__getitem__, sorted(hits)))
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``SAMPLE_ROWS`` labelled rows outside the held-out third, by smallest hash of the id: id, y, text.

    Near copies would make chance words look telling, so of rows that share the least or the greatest hash of their shingles
    one stays. A row that several labels name counts as toxic if one does. Ids are whole numbers of any type, labels numbers or booleans. Rows without id, label or document are left out.
    """
    named = labels.where(F.col("toxic").isNotNull() & (remainder("doc_id", 3) != 1)).groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("_y"))
    present = named.join(docs.select(F.col(doc_id).cast("bigint").alias("_id")).distinct(), "_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    sample = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")
    keyed = sample.mapInArrow(_copy_keys, "_id bigint, _y int, _text string, _lo bigint, _hi bigint")
    one = F.min(F.struct("_id", "_y", "_text", "_hi")).alias("s")
    return keyed.groupBy("_lo").agg(one).select("s.*").groupBy("_hi").agg(F.min(F.struct("_id", "_y", "_text")).alias("s")).select("s.*")


def _copy_keys(batches):
    """Least and greatest shingle hash of each sampled text; near copies mostly share one of them."""
    import pyarrow as pa

    shingle = Shingler()
    for b in batches:
        for part, texts in text_slices([b], "_text"):
            sets = [shingle(t).view(np.int64) for t in texts.to_pylist()]
            ids = part.column(0).to_pylist()
            ends = [[int(f(s)) if len(s) else i for s, i in zip(sets, ids, strict=True)] for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(e, pa.int64()) for e in ends)], names=["_id", "_y", "_text", "_lo", "_hi"])


def _count_features(batches):
    """Documents per feature and class, summed over a task's part of the bounded sample."""
    import pyarrow as pa

    counts = (Counter(), Counter())
    for b in batches:
        for part, texts in text_slices([b], "_text"):
            for y, t in zip(part.column(0).to_pylist(), texts.cast(pa.large_string()).to_pylist(), strict=True):
                counts[1 if y else 0].update(features(t))
    names = list({**counts[0], **counts[1]})
    for i in range(0, len(names), 10_000):
        some = names[i:i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([float(counts[1][f]) for f in some]),
                                          pa.array([float(counts[0][f]) for f in some])], names=["f", "a", "b"])


def _sparse_rows(sample: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and the features of each sampled row as row numbers and feature numbers, sorted by row."""
    ids = per_text(sample, "_text", {"f": "array<int>"}, lambda: lambda texts: [
        [sorted(vocabulary[f] for f in features(t) if f in vocabulary) for t in texts]], keep_text=False)
    rows = sorted((r["_id"], r["_y"], tuple(r["f"])) for r in ids.collect())
    y = np.array([r[1] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    return y, at, np.array([f for r in rows for f in r[2]], int)


def _label_model(votes: np.ndarray, prior: float, fires: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 from votes (rows x voters, 1 = fires), and each voter's share of its correlated group.

    ``fires`` are labelled estimates of P(fires | class), classes x voters; they weigh as much as the votes do in each
    refinement. A voter that does not fire abstains; that a row
    gets no vote at all is evidence of its own. Voters that fire together more often than their accuracies explain share
    one vote: the log-odds of a voter are divided by the sum of its correlations given the class.
    """
    silent = votes.sum(axis=1) == 0
    start, held = fires, np.array([[1 - prior], [prior]]) * len(votes)
    p = np.full(len(votes), prior)
    share, none = np.ones(votes.shape[1]), np.array([0.9, 0.1])
    for step in range(rounds):
        z = np.log(prior / (1 - prior)) + votes @ (np.log(fires[1] / fires[0]) * share)
        z = np.where(silent, z + np.log(none[1] / none[0]), z)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        weight = np.stack([1 - p, p])
        mass = weight.sum(axis=1)
        fires = np.clip((weight @ votes + held * start) / (mass[:, None] + held), 1e-5, 1 - 1e-5)
        none = np.clip((weight @ silent + 0.5) / (mass + 1.0), 1e-5, 1 - 1e-5)
        prior = float(np.clip(p.mean(), 1e-3, 0.999))
        if step == 0:
            rest = votes - (fires[0] * (1 - p)[:, None] + fires[1] * p[:, None])
            cov = rest.T @ rest / max(1, len(votes))
            sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
            corr = cov / sd[:, None] / sd[None, :]
            share = 1 / np.where(corr >= CORRELATED, corr, 0).sum(axis=1).clip(1)
    return p, share


def _logistic(at: np.ndarray, f: np.ndarray, n_features: int, target: np.ndarray, l2: float = 1e-5, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Minimise the penalised cross entropy against soft targets; adaptive gradient steps on all rows."""
    w, b, n = np.zeros(n_features), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))), max(1, len(target))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = b + np.bincount(at, w[f], minlength=len(target))
        g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        gw, gb = np.bincount(f, g[at], minlength=n_features) / n + l2 * w, g.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.1 * (mb / c1) / (vb / c2 + 1e-16) ** 0.5
    return b, w


def _evidence(a, b, n1: int, n0: int):
    """Likelihood ratio statistic of a feature's documents per class against the same share in both."""
    n = n1 + n0

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    m = a + b
    return 2 * (part(a, m * n1 / n) + part(b, m * n0 / n) + part(n1 - a, (n - m) * n1 / n) + part(n0 - b, (n - m) * n0 / n))


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """Logit that parts the labelled rows with the fewest errors, in the middle of the widest such gap."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    best = np.flatnonzero(errors == errors.min())
    at = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[at] + edges[at + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> ToxicityModel:
    """Mine voters from the labelled sample, fit the label model, train the classifier on its posteriors.

    Words and beginnings of words are counted per class on Spark. The strongest for toxic texts of each family vote, ``MAX_VOTERS`` at most; the
    label model starts from their labelled frequencies and refines accuracies and correlations by expectation
    maximisation; the classifier sees the ``MAX_FEATURES`` most telling features, and its bias is
    set so that the cut with the fewest errors on the sample scores ``threshold``. Without labelled rows of both classes
    the model gives every text the share of toxic labels (0.5 without any).
    """
    sample = labelled_sample(docs, labels, doc_id, text)
    by_class = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    n0, n1 = by_class.get(0, 0), by_class.get(1, 0)
    if not n0 or not n1:
        p = (n1 + 0.5) / (n0 + n1 + 1)
        return ToxicityModel(float(np.log(p / (1 - p))))
    counts = (sample.select("_y", "_text").mapInArrow(_count_features, "f string, a double, b double").groupBy("f")
              .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCS))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    told = counts.select("f", "a", "b", odds.alias("odds"), _evidence(F.col("a"), F.col("b"), n1, n0).alias("told"))
    chosen = told.where(F.col("told") > LEAST_EVIDENCE).orderBy(F.desc("told"), "f").limit(MAX_FEATURES).collect()
    vocabulary = {r["f"]: i for i, r in enumerate(chosen)}
    y, at, f = _sparse_rows(sample, vocabulary)
    families: dict[str, int] = {}
    for r in chosen:
        if r["odds"] > LEAST_ODDS:
            families.setdefault(r["f"][:FAMILY], vocabulary[r["f"]])
    voters = np.array(list(families.values())[:MAX_VOTERS], int)
    prior = n1 / (n0 + n1)
    if len(voters):
        column = np.full(len(vocabulary), -1)
        column[voters] = np.arange(len(voters))
        votes = np.zeros((len(y), len(voters)), np.float32)
        hit = column[f] >= 0
        votes[at[hit], column[f[hit]]] = 1
        start = np.array([[(chosen[i]["b"] + 0.5) / (n0 + 1) for i in voters], [(chosen[i]["a"] + 0.5) / (n1 + 1) for i in voters]])
        posterior, _ = _label_model(votes, prior, np.clip(start, 1e-5, 1 - 1e-5))
    else:
        posterior = np.full(len(y), prior)
    bias, w = _logistic(at, f, len(vocabulary), posterior)
    bias += np.log(threshold / (1 - threshold)) - _cut(bias + np.bincount(at, w[f], minlength=len(y)), y)
    return ToxicityModel(float(bias), {k: float(w[i]) for k, i in vocabulary.items() if abs(w[i]) > 1e-6})


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) for each whole text.

    Null and empty texts get the model's base rate. Only the text is looked at; other columns pass through, columns of
    those two names are replaced, repeated rows get the same score each.
    """
    out = per_text(docs.drop("predicted"), text, {"score": "double"}, lambda: (lambda s: lambda texts: [[s(t) for t in texts]])(model.scorer()))
    return out.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
