"""Language-model scores: a lattice of subword pieces, and a smoothed word model beside it."""
from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opslake.llm.rows import remainder, text_slices
from opslake.session import fresh_path

#: Word types at most that are shipped to every worker; all others meet their counts in a join.
HEAD_WORDS = 100_000
#: Word types a task counts before it hands its counts on.
COUNTED_WORDS = 500_000
#: Smoothing of a piece's count.
PIECE_PRIOR = 0.1
#: Words up to this length are scored together, by length, so many at a time.
BATCH_CHARS, BATCH_WORDS = 48, 2_048

MARK = "▁"  # fixed value: the mark of a word's start in the pieces


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space; bytes methods do just that."""
    return text.lower().split()


@functools.lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@dataclass
class PieceModel:
    """Log probabilities (natural) of the pieces of an existing vocabulary, of single bytes and of the end."""

    pieces: dict[str, float]
    bytes_: tuple[float, ...]
    end: float
    longest: int

    def char(self, c: str) -> float:
        """A character that is no piece is spelled by its bytes."""
        return sum(self.bytes_[b] for b in c.encode("utf-8", "surrogatepass"))

    def word(self, word: str) -> float:
        """Log of the summed probability of all segmentations of one word, by forward recursion in logs."""
        text = MARK + word
        get, at = self.pieces.get, [0.0]
        for end in range(1, len(text) + 1):
            terms = [at[i] + p for i in range(max(0, end - self.longest), end) if (p := get(text[i:end])) is not None]
            if text[end - 1] not in self.pieces:
                terms.append(at[end - 1] + self.char(text[end - 1]))
            top = max(terms)
            at.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return at[-1]

    @functools.cached_property
    def starts(self) -> dict[str, float]:
        """Every beginning of a piece; 1.0 marks those that are no piece themselves."""
        out = {p[:n]: 1.0 for p in self.pieces for n in range(1, len(p))}
        out.update(self.pieces)
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """``word`` of many words: those of one length go through the recursion together."""
        out = np.empty(len(words))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) <= BATCH_CHARS:
                by_length.setdefault(len(w), []).append(i)
            else:
                out[i] = self.word(w)
        get, pieces = self.starts.get, self.pieces
        for n, rows in ((n, r[k:k + BATCH_WORDS]) for n, r in by_length.items() for k in range(0, len(r), BATCH_WORDS)):
            size, count = n + 1, len(rows)
            width = min(self.longest, size) + 1
            at, logs = [], []
            for k, i in enumerate(rows):
                text = MARK + words[i]
                for start in range(size):
                    for end in range(start + 1, size + 1):
                        p = get(text[start:end])
                        if p is None:
                            break
                        if p <= 0:
                            at.append((end * width + end - start) * count + k)
                            logs.append(p)
                    if text[start] not in pieces:
                        at.append(((start + 1) * width + 1) * count + k)
                        logs.append(self.char(text[start]))
            lattice = np.full((size + 1) * width * count, -np.inf)
            lattice[at] = logs
            lattice = lattice.reshape(size + 1, width, count)
            total = np.full((size + 1, count), -np.inf)
            total[0] = 0.0
            for e in range(1, size + 1):
                terms = np.stack([total[e - m] + lattice[e, m] for m in range(1, min(width - 1, e) + 1)])
                top = terms.max(axis=0)
                total[e] = top + np.log(np.exp(terms - top).sum(axis=0))
            out[rows] = total[size]
        return out

    def spelled(self, tokens: list[bytes]) -> np.ndarray:
        return self.words([t.decode("utf-8", "replace") for t in tokens])


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Token counts (token binary, n) of all texts; the end of a document is the empty token.

    Each task adds up its own tokens before the shuffle, so a word that every text has costs one row per task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush():
            tokens = list(counts)
            for i in range(0, len(tokens), 50_000):
                some = tokens[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([counts[t] for t in some], pa.int64())],
                                                 names=["token", "n"])
            counts.clear()

        for _, texts in text_slices(batches, text):
            for t in texts.to_pylist():
                counts.update(words_of(t))
                counts[b""] += 1
            if len(counts) > COUNTED_WORDS:
                yield from flush()
        yield from flush()

    return docs.select(text).mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def fit_pieces(counts: DataFrame, vocabulary: str) -> PieceModel:
    """Probabilities of the vocabulary's pieces: their smoothed counts where the vocabulary's own rule cuts the words.

    Every word type of ``counts`` is cut once and weighs as often as it occurs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(vocabulary)
        held = np.zeros(sp.get_piece_size() + 1)
        for b in batches:
            words = [w.decode("utf-8", "replace") for w in b.column("token").to_pylist()]
            n = b.column("n").to_numpy()
            held[-1] += n[[not w for w in words]].sum()
            ids = sp.encode(words, num_threads=1)
            lengths = np.array([len(i) for i in ids])
            np.add.at(held, np.array([x for i in ids for x in i], int), np.repeat(n, lengths))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at].astype(np.int64))], names=["piece", "n"])

    sp = _processor(vocabulary)
    size = sp.get_piece_size()
    held = np.full(size + 1, PIECE_PRIOR)
    for r in counts.mapInArrow(run, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        held[r["piece"]] += r["n"]
    usable = [not (sp.is_control(i) or sp.is_unknown(i)) for i in range(size)] + [True]
    held[~np.array(usable)] = 0
    logs = np.log(np.where(held > 0, held, 1) / held.sum())
    spelled = {sp.id_to_piece(i): float(logs[i]) for i in range(size) if usable[i] and not sp.is_byte(i)}
    raw = [float(logs[sp.piece_to_id(f"<0x{b:02X}>")]) for b in range(256)]
    return PieceModel(spelled, tuple(raw), float(logs[size]), max(map(len, spelled)))


def score(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", fold: int = 5, held: int = 1) -> DataFrame:
    """Score every whole text under a subword lattice and under a word model, both learned from the other folds.

    Documents whose crc32 of the id as text modulo ``fold`` is ``held`` are held out; a null id is not. Tokens: words
    between ASCII white space with A-Z lower-cased, then one end. The base score adds log10((c + 0.5) / (N + 0.5 (V + 1)))
    over the tokens. The score is the log10 probability of the text as a sequence of pieces with an end: each word, with
    its start marked, sums over all its segmentations. Null or empty text is one end. With no training text all
    counts are zero and pieces are equally likely. Each row is scored for itself, repeated ids included; other columns are
    not kept. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The counts of the ``HEAD_WORDS`` most frequent words go to every worker; the others' tokens meet their counts in a
    join in which, the frequent words being out of it, no key is hot.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(remainder(doc_id, fold) == held, F.lit(False))
    path = fresh_path(spark, "words")
    count_words(docs.where(~held_out), text).write.parquet(path)
    counts = spark.read.schema("token binary, n bigint").parquet(path)
    model = fit_pieces(counts, vocabulary)
    path = fresh_path(spark, "lattices")
    counts.mapInArrow(_add_lattice(spark.sparkContext.broadcast(model)), "token binary, n bigint, lattice double").write.parquet(path)
    counts = spark.read.schema("token binary, n bigint, lattice double").parquet(path)
    total = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.octet_length("token") == 0, F.col("n")))).first()
    n, v, ends = total[0] or 0, total[1], total[2] or 0
    floor = math.log10(n + 0.5 * (v + 1))
    head = counts.where((F.octet_length("token") > 0) & (F.col("n") >= _head_count(counts))).toArrow()
    shipped = spark.sparkContext.broadcast(({w: i for i, w in enumerate(head.column("token").to_pylist())},
                                            np.log10(head.column("n").to_numpy() + 0.5) - floor, head.column("lattice").to_numpy()))
    end_base, end_lattice = math.log10(ends + 0.5) - floor, model.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base, lattice = shipped.value
        for part, texts in text_slices(batches, text):
            out = []
            for t in texts.to_pylist():
                words = words_of(t)
                at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                tail = [words[i] for i in np.flatnonzero(at < 0)]
                at = at[at >= 0]
                out.append((len(words) + 1, len(at), float(base[at].sum()), float(lattice[at].sum()), tail))
            types = pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())
            arrays = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["_id", "_held", "_n", "_known", "_base", "_lattice", "_tail"])

    kind = docs.schema[doc_id].dataType.simpleString()
    path = fresh_path(spark, "scores")
    scored = docs.select(F.col(doc_id).alias("_id"), held_out.alias("_held"), F.col(text)).mapInArrow(
        run, f"_id {kind}, _held boolean, _n bigint, _known bigint, _base double, _lattice double, _tail array<binary>")
    scored.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)

    tail = rows.select("_row", F.explode("_tail").alias("token")).join(counts, "token", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    rest = tail.groupBy("_row").agg(F.sum((c > 0).cast("long")).alias("_more"), F.sum(F.log10(c + 0.5) - floor).alias("_rest"), F.sum("lattice").alias("_spelled"),
                                    F.collect_list(F.when(F.col("n").isNull(), F.col("token"))).alias("_new"))
    rest = rest.mapInArrow(_spell_new(spark.sparkContext.broadcast(model)), "_row bigint, _more bigint, _rest double, _spelled double")
    log10 = math.log(10)
    return rows.drop("_tail").join(rest, "_row", "left").select(
        F.col("_id").alias("doc_id"), F.col("_held").alias("held_out"), F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_more", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_rest", F.lit(0.0)) + end_base).alias("base_score"),
        ((F.col("_lattice") + F.coalesce("_spelled", F.lit(0.0)) + end_lattice) / log10).alias("score"))


def _head_count(counts: DataFrame) -> int:
    """Least count of a head word: the lowest of a fixed ladder of counts that at most ``HEAD_WORDS`` words reach."""
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    held, least = 0, 1 << 62
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        held += r["k"]
        if held > HEAD_WORDS:
            break
        least = r["n"]
    return least


def _add_lattice(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = model.value.spelled(b.column("token").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(logs)], names=["token", "n", "lattice"])

    return run


def _spell_new(model):
    """Add the lattice logs of each row's words that no training text has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = b.column("_new").to_pylist()
            words = list({w for ws in new for w in ws})
            logs = dict(zip(words, model.value.spelled(words).tolist(), strict=True))
            spelled = [(s or 0.0) + sum(logs[w] for w in ws) for s, ws in zip(b.column("_spelled").to_pylist(), new, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("_more"), b.column("_rest"), pa.array(spelled, pa.float64())],
                                             names=["_row", "_more", "_rest", "_spelled"])

    return run
