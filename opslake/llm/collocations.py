"""Phrases whose words go together, from exact counts of all n-grams that are frequent enough."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from opslake.llm.rows import text_slices
from opslake.plans.sizing import broadcast_if_small, has_at_most
from opslake.session import fresh_path

#: Words of a shard (a longer piece stays whole); a bound on what one index holds. Rows of a batch that leaves a task, and rows that are summed in it.
SHARD_WORDS, BATCH_ROWS, HELD_ROWS = 1 << 19, 1 << 14, 1 << 18
#: Shards of one file, so that a task reads few of them.
SHARDS_PER_FILE = 3
#: Shards whose counts of longer phrases one task sums; with fewer shards in all, tasks are this many per core.
SUMMED_SHARDS, TASKS_PER_CORE = 64, 4
#: Frequent phrases of one length whose 64-bit digests are sent to every task.
LIST_ROWS = 1 << 24
#: Odd numbers that digests multiply with: one for each place in a word, and one for each word of a phrase.
FACTORS = np.random.default_rng(13).integers(1 << 62, size=1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUES = np.random.default_rng(14).integers(1 << 63, size=256, dtype=np.uint64)
#: What ends a piece. No word can hold a full stop, so it stands for the end of a piece among the words.
PIECE_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
END = b"."
#: Language of rows without one.
NO_LANG = "und"


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class FMIndex:
    """Burrows-Wheeler transform of a sequence of ids, in which 0 ends a piece; extends phrases on the side that precedes them.

    The index of the reversed sequence extends to the other side, so a pair of them is a bidirectional index.
    """

    def __init__(self, bwt: np.ndarray):
        n = len(bwt)
        self.bwt, self.n, self.occurrences = bwt, n, np.sort(bwt.astype(np.int64) * n + np.arange(n))

    @staticmethod
    def transform(x: np.ndarray, depth: int) -> np.ndarray:
        """The transform of x, which ends with 0, with suffixes sorted by their first ``depth`` ids, which is enough for phrases of so many words."""
        n = len(x)
        bits = int(x.max(initial=0)).bit_length() or 1
        packed = max(1, min(depth, 62 // bits))
        key, padded = np.zeros(n, np.int64), np.append(x, np.zeros(depth, x.dtype)).astype(np.int64)
        for k in range(packed):
            key |= padded[k:k + n] << (bits * (packed - 1 - k))
        order, known = np.argsort(key), packed
        while known < depth:
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([1], key[1:] != key[:-1])))
            key = rank * (n + 1)
            key[:max(0, n - known)] += rank[known:]
            order, known = np.argsort(key), known * 2
        return np.where(order > 0, x[order - 1], 0)

    def extend(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of phrases that have ``word`` before the phrases of the given intervals."""
        at = word.astype(np.int64) * self.n
        return np.searchsorted(self.occurrences, at + low), np.searchsorted(self.occurrences, at + high)

    def find(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of phrases given word by word, the one nearest to the extended side last."""
        low, high = np.zeros(len(words[0]), np.int64), np.full(len(words[0]), self.n, np.int64)
        for w in words:
            low, high = self.extend(w, low, high)
        return low, high

    def extensions(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase number, word before it, count) of all one-word extensions within pieces."""
        size = high - low
        phrase = np.repeat(np.arange(len(low)), size)
        row = np.arange(len(phrase)) - np.repeat(np.cumsum(size) - size, size) + low[phrase]
        word = self.bwt[row]
        inside = word > 0
        width = int(self.bwt.max(initial=0)) + 1
        pairs, count = np.unique(phrase[inside] * width + word[inside], return_counts=True)
        return pairs // width, pairs % width, count


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(x.astype(np.int32).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(blob), np.int32)


def _make_index(limit: int, depth: int):
    """Arrow rows, one per shard: language, number of words, distinct words (id - 1 is their place) and both transforms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held: dict[str, tuple[_Ids, list[np.ndarray], list[int]]] = {}

        def out(lang: str) -> pa.RecordBatch:
            ids, parts, _ = held.pop(lang)
            x = np.concatenate(parts)
            both = [_packed(FMIndex.transform(np.append(y, 0), depth)) for y in (x, x[::-1])]
            words = zstandard.compress(b"\n".join(list(ids)[1:]), 1)
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int((x > 0).sum())], pa.int64()), *[pa.array([b], pa.binary()) for b in (words, *both)]],
                                              ["lang", "n", "words", "before", "after"])

        for part, texts in text_slices(batches, "text"):
            for lang, text in zip(part.column(0).to_pylist(), texts.to_pylist(), strict=True):
                words = [w for w in PIECE_ENDS.sub(b" . ", text.lower()).replace(b"\t", b" ").split(b" ") if w]
                words.append(END)
                start = 0
                while start < len(words):
                    end = min(len(words), start + limit)
                    while words[end - 1] != END:  # a piece that is longer than a shard stays whole
                        end += 1
                    ids, parts, size = held.setdefault(lang, (_Ids({END: 0}), [], [0]))
                    parts.append(np.fromiter(map(ids.__getitem__, words[start:end]), np.int32, end - start))
                    size[0] += end - start
                    start = end
                    if size[0] >= limit:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    return run


def _words(batch: pa.RecordBatch, i: int) -> pa.Array:
    import zstandard

    blob = zstandard.decompress(batch.column("words")[i].as_py())
    return pa.array(blob.split(b"\n") if blob else [], pa.binary()).cast(pa.string())


def _counted(batch: pa.RecordBatch, i: int, words: pa.Array, columns: list[np.ndarray], count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of phrases given word by word (from 1) and their counts in the i-th shard of a batch."""
    shard, lang = (batch.column(c)[i].as_py() for c in ("shard", "lang"))
    for k in range(0, len(count), BATCH_ROWS):
        parts = [words.take(pa.array(c[k:k + BATCH_ROWS] - 1)) for c in columns]
        phrases = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
        n = len(phrases)
        yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array([lang] * n, pa.string()), phrases,
                                          pa.array(count[k:k + BATCH_ROWS], pa.int64())], ["shard", "lang", "phrase", "n"])


def _words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, per shard, of all words and all pairs of words."""
    for batch in batches:
        for i in range(batch.num_rows):
            words = _words(batch, i)
            after = FMIndex(_unpacked(batch.column("after")[i].as_py()))
            single = np.arange(1, len(words) + 1)
            yield from _counted(batch, i, words, [single], np.bincount(after.bwt, minlength=len(words) + 1)[1:])
            first, second, count = after.extensions(*after.find([single]))
            del after
            yield from _counted(batch, i, words, [first + 1, second], count)
            pa.default_memory_pool().release_unused()


def _word_digests(words: pa.Array) -> np.ndarray:
    """64-bit digests of words, none of them empty, from their bytes and places."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.empty(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data, start = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]], ends[:-1] - ends[0]
    place = np.arange(len(data)) - np.repeat(start, np.diff(ends))
    out = np.add.reduceat(BYTE_VALUES[data] * FACTORS[place % len(FACTORS)], start)
    out = (out ^ (out >> np.uint64(32))) * FACTORS[0]
    return out ^ (out >> np.uint64(29))


def _phrase_digests(lang: str, columns: list[np.ndarray]) -> np.ndarray:
    """Digests of phrases from those of their words, given word by word."""
    out = np.repeat(_word_digests(pa.array([f"{lang}."])), len(columns[0]))
    for k, column in enumerate(columns):
        out += FACTORS[k % len(FACTORS)] * column
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of phrases (lang, phrase) of one length, many in a row."""
    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            phrases = pc.split_pattern(batch.column(1).filter(pc.equal(batch.column(0), lang)), " ")
            table = _word_digests(phrases.flatten()).reshape(len(phrases), -1)
            yield pa.RecordBatch.from_arrays([pa.array([_phrase_digests(lang, list(table.T)).tobytes()], pa.binary())], ["digests"])


def _among(digests: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether digests are in an ordered list; they are ordered first, as neighbours are then looked up together."""
    if not len(ordered):
        return np.zeros(len(digests), bool)
    order = np.argsort(digests)
    asked, out = digests[order], np.empty(len(digests), bool)
    out[order] = ordered[np.minimum(np.searchsorted(ordered, asked), len(ordered) - 1)] == asked
    return out


def _one_more(before: FMIndex, after: FMIndex, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases one word longer than the given ones (rows of word numbers) of which both ends are given, and their counts."""
    columns = list(table.T)
    right_of, right, count = after.extensions(*after.find(columns))
    left_of, left, _ = before.extensions(*before.find(columns[::-1]))
    longer = np.column_stack((table[right_of], right)).astype(np.int64)
    odd = np.random.default_rng(13).integers(1 << 62, size=longer.shape[1], dtype=np.int64) * 2 + 1
    # Equal sums of unequal phrases would only let a phrase through that the global sum drops later.
    both = np.isin(longer @ odd, np.column_stack((left, table[left_of])).astype(np.int64) @ odd)
    return longer[both], count[both]


def _longer(batch: pa.RecordBatch, i: int, lists: list[np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Counts, in the i-th shard of a batch, of the phrases one word longer than the frequent ones of which both ends are frequent.

    ``lists`` has the ordered digests of the frequent phrases of two words, of three and so on; the shard takes from its own
    phrases of each length those that are among them. Without it the row brings the frequent phrases that the shard has.
    """
    words = _words(batch, i)
    if lists is None:
        given = pc.split_pattern(pc.split_pattern(batch.column("phrases").slice(i, 1), "\n").flatten(), " ")
        table = pc.fill_null(pc.index_in(given.flatten(), words), -1).to_numpy().reshape(len(given), -1) + 1
        table = table[(table > 0).all(axis=1)]
        del given
        if len(table) == 0:
            return
    before, after = (FMIndex(_unpacked(batch.column(c)[i].as_py())) for c in ("before", "after"))
    if lists is not None:
        lang = batch.column("lang")[i].as_py()
        digest = np.append(np.uint64(0), _word_digests(words))
        first, second, _ = after.extensions(*after.find([np.arange(1, len(words) + 1)]))
        table = np.column_stack((first + 1, second)).astype(np.int64)
        for k, ordered in enumerate(lists):
            if k:
                table, _ = _one_more(before, after, table)
            # Equal digests of unequal phrases would only let a phrase through as well.
            table = table[_among(_phrase_digests(lang, [digest[c] for c in table.T]), ordered)]
            if len(table) == 0:
                return
    table, count = _one_more(before, after, table)
    yield from _counted(batch, i, words, list(table.T), count)


def _grow(batches: Iterator[pa.RecordBatch], **lists: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield from _longer(batch, i, **lists)


def _grow_and_sum(batches: Iterator[pa.RecordBatch], **lists: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """As ``_grow``, with the counts of the shards of a task summed before they leave it, as far as HELD_ROWS allows.

    Counts are summed whenever HELD_ROWS more have come, and go on being held unless over twice as many are left then.
    """
    held: list[pa.RecordBatch] = []
    limit = HELD_ROWS

    def add_up() -> int:
        table = pa.Table.from_batches(held).group_by(["lang", "phrase"]).aggregate([("n", "sum"), ("shard", "min")])
        held[:] = table.rename_columns(["lang", "phrase", "n", "shard"]).select(["shard", "lang", "phrase", "n"]).to_batches(max_chunksize=BATCH_ROWS)
        return table.num_rows

    for batch in batches:
        for i in range(batch.num_rows):
            held += _longer(batch, i, **lists)
            pa.default_memory_pool().release_unused()
            if sum(h.num_rows for h in held) > limit:
                rows = add_up()
                if rows > 2 * HELD_ROWS:
                    yield from held
                    held.clear()
                    rows = 0
                limit = rows + HELD_ROWS
    if held:
        add_up()
        yield from held


def _with_lists(step: Callable, sent: list):
    """``step`` with the lists of digests that were sent to the tasks."""
    return lambda batches: step(batches, lists=[s.value for s in sent]) if sent else step(batches)


COUNTS = "shard bigint, lang string, phrase string, n bigint"


def _written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frequent_phrases(docs: DataFrame, min_count: int, max_words: int, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``max_words`` words found at least ``min_count`` times, and the words of each language.

    The first part has lang, phrase (words joined by spaces), size and f; the second lang and n. Texts are lower-cased
    (A-Z), pieces end at ``.,;:!?`` and at line ends, words at spaces and tabs; a phrase lies within a piece. Counts are exact.

    Texts become shards of about half a million words in the tasks that read them, none of them shuffled. Each shard keeps a
    bidirectional index. Words and pairs are counted in all shards and summed; from there on, level by level, each shard
    extends those of its phrases that are frequent over all shards by one word on either side and keeps what both sides
    give. A phrase can only be frequent if both phrases one word shorter are, so nothing is lost. If a level's frequent phrases are
    counted to be at most LIST_ROWS, tasks get their digests and each shard looks its own phrases up, so a shard's work follows
    its text and not that list; else, and for longer ones then, each shard is joined with those it has. Most
    candidates are rare and cannot be told from the frequent ones before all shards are summed, so a task sums many shards
    and sends each of its candidates on once: at most one row per word and level, fewer the more shards it sums.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    made = rows.mapInArrow(_make_index(SHARD_WORDS, max_words), "lang string, n bigint, words binary, before binary, after binary")
    index = _written(made.withColumn("shard", F.monotonically_increasing_id()), "phrase-index", SHARDS_PER_FILE)
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, index.count() // SUMMED_SHARDS)
    counts = summed = index.mapInArrow(_words_and_pairs, COUNTS)
    found, held = [], []
    for size in range(2, max_words + 1):
        totals = summed.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        found.append(_written(totals.withColumn("size", F.size(F.split("phrase", " "))), "phrases"))
        last = found[-1].where(F.col("size") == size).select("lang", "phrase")
        if size == max_words:
            break
        if held is not None and has_at_most(last, LIST_ROWS):
            digests = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r[0], np.uint64) for r in last.mapInArrow(_digests, "digests binary").collect())])
            digests.sort()
            held = [*held, spark.sparkContext.broadcast(digests)]
            given, sent = index, held
        else:
            phrases = F.array_join(F.collect_list("phrase"), "\n").alias("phrases")
            own = counts.join(last.hint("merge"), ["lang", "phrase"], "left_semi").groupBy("shard").agg(phrases)
            given, sent, held = index.join(own.hint("merge"), "shard"), [], None
        counts, summed = given.mapInArrow(_with_lists(_grow, sent), COUNTS), given.coalesce(tasks).mapInArrow(_with_lists(_grow_and_sum, sent), COUNTS)
    return reduce(DataFrame.unionByName, found), index.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, covered: int = 100, top: int | None = 2000,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """Phrases of 2 to ``max_words`` words that occur at least ``min_count`` times, ranked by how much their parts attract each other.

    Per language: n counts all words, a the phrase; cut after its first k words it has parts found l and r times and the
    score floor(1000 a n / (l r)). The lowest-scoring cut counts, of equal ones the one with the smallest k. A phrase goes if a
    longer one that holds it has ``100 * f(longer) >= covered * a``. Returns lang, rank (from 1), phrase, a, l, r, n and
    score of the first ``top`` phrases of each language (all if None) by score and a descending, then phrase in byte
    order. Null text is empty, a null language is ``und``; other columns are not read; repeated rows count
    each. No rows give no rows.
    """
    phrases, sizes = frequent_phrases(docs, min_count, max_words, lang, text)
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(F.col("words"), start, length), " ")
    long = phrases.where("size > 1").withColumn("words", words)
    counts = broadcast_if_small(phrases.select("lang", "phrase", "f"))
    cuts = long.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("head"),
        part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    for name, side in (("l", "head"), ("r", "tail")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    scored = cuts.join(broadcast_if_small(sizes), "lang").withColumn("over", F.expr("cast(a * 1000 as decimal(18,0)) * cast(n as decimal(19,0))")).withColumn(
        "under", F.expr("cast(l as decimal(18,0)) * cast(r as decimal(19,0))"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut"),
                                                 F.first("a").alias("a"), F.first("n").alias("n"))
    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    inner = long.where("size > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = worst.join(inner, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * covered))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)) if top is None else kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
