"""Secrets by fixed patterns and by probabilistic automata inferred from what the patterns found."""
from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame, functions as F

from opslake.llm.rows import per_text, shielded, without
from opslake.session import fresh_path

# The base patterns, and the kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # equals dropping shorter maximal runs
KINDS = ("assign", "access", "hex", "format")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CREDENTIAL = r"[A-Za-z0-9+/_.=-]"
#: Runs of credential characters that are long enough to be scored.
CANDIDATE = re.compile(rf"(?<!{CREDENTIAL}){CREDENTIAL}{{16,}}")
NUMBER = re.compile(r"[0-9.+-]+")
SPAN = "array<struct<start:int,end:int,kind:int>>"
FOUND = "array<struct<start:int,end:int,value:string>>"

#: Bounds of the labelled sample: values per kind, background runs, and characters of a value.
SAMPLE_VALUES, SAMPLE_BACKGROUND, SAMPLE_CHARS = 1_000, 4_000, 128
#: Log-likelihood ratio, in nats, of a format against ordinary runs above which a run counts as credential.
LEAST_RATIO = 10.0
#: Share of the labelled values that may lie below the level from which a run is no example of ordinary ones;
#: the least such level, in nats per character, as labelled values can be ordinary words; and what is taken off, as the automaton
#: of unlabelled runs was fitted to them.
LOW_SHARE, LOW_RATIO, LOW_SLACK = 0.05, -0.8, 0.3


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Matches of the base patterns as (start, end, kind), by start and kind; and the spans of their values."""
    spans, values = [], []
    low = text.lower()  # only asked whether a key word can be there
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                spans.append((m.start(), m.end(), 0))
                values.append((m.start(2), m.end(2), 0))
    if "AKIA" in text:
        hits = [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        spans += hits
        values += hits
    hits = [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans + hits, key=lambda s: (s[0], s[2])), values + hits


def _scan():
    def call(texts):
        found, values, runs = [], [], []
        for t in texts:
            spans, vals = base_spans(t)
            rest = [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(t)]
            if spans and rest:
                rest = [c for c in rest if not any(s < c[1] and c[0] < e for s, e, _ in spans)]
            found.append([dict(zip(("start", "end", "kind"), s)) for s in spans])
            values.append([{"kind": k, "value": t[s:e]} for s, e, k in vals])
            runs.append([dict(zip(("start", "end", "value"), c)) for c in rest])
        return found, values, runs

    return call


class Automaton:
    """A deterministic automaton with probabilities, got by merging compatible states of a prefix tree."""

    ALPHABET = 67  # credential characters and the end

    def __init__(self, values: list[str], alpha: float = 0.05):
        self.total, self.final = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        for v in values:
            at = 0
            self.total[0] += 1
            for c in v:
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.total)
                    self.total.append(0)
                    self.final.append(0)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                at = self.next[at][c]
                self.total[at] += 1
            self.final[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.total[p], self.total[q]
            if not n or not m:
                continue
            if self._differ(self.final[p], n, self.final[q], m):
                return False
            for c in {*self.next[p], *self.next[q]}:
                if self._differ(self.count[p].get(c, 0), n, self.count[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.total[p] += self.total[q]
            self.final[p] += self.final[q]
            for c, child in self.next[q].items():
                self.count[p][c] += self.count[q][c]
                if c in self.next[p]:
                    todo.append((self.next[p][c], child))
                else:
                    self.next[p][c] = child

    def _merge_states(self) -> None:
        kept, known = [0], {0}
        while True:
            edge = next(((p, c, q) for p in kept for c, q in sorted(self.next[p].items()) if q not in known), None)
            if edge is None:
                break
            p, c, q = edge
            into = next((r for r in kept if self._compatible(r, q)), None)
            if into is None:
                kept.append(q)
                known.add(q)
            else:
                self.next[p][c] = into
                self._fold(into, q)
        self.states = len(kept)
        keep = set(kept)
        self.log = {s: {c: math.log((n + 0.05) / (self.total[s] + 0.05 * self.ALPHABET)) for c, n in self.count[s].items()}
                    for s in keep}
        self.end = {s: math.log((self.final[s] + 0.05) / (self.total[s] + 0.05 * self.ALPHABET)) for s in keep}
        self.rare = {s: math.log(0.05 / (self.total[s] + 0.05 * self.ALPHABET)) for s in keep}
        self.next = {s: self.next[s] for s in keep}
        del self.count, self.total, self.final

    def score(self, value: str, strict: bool = False) -> float:
        """Log-likelihood. A character never seen in a state costs the smoothed share and stays there; minus infinity if strict."""
        at, sum_ = 0, 0.0
        for c in value:
            p = self.log[at].get(c)
            if p is None:
                if strict:
                    return -math.inf
                sum_ += self.rare[at]
            else:
                sum_ += p
                at = self.next[at][c]
        return sum_ + self.end[at]


class Formats:
    """One automaton per kind of credential, and one for ordinary runs.

    The unlabelled runs hold bare credentials too, in any share. Those that score as labelled values do are
    set aside and the automaton of ordinary runs is inferred anew from the others, and last from all that stay at or below LEAST_RATIO,
    so that runs set aside too early come back. Where most runs are bare credentials, a format can still be missed.
    """

    def __init__(self, labelled: dict[int, list[str]], background: list[str]):
        labelled = [v for v in labelled.values() if v]
        self.kinds = [Automaton(v) for v in labelled]
        self.plain = Automaton(background or ["-"])
        scored = []  # labelled values with their likelihood by their kind, and of each half by an automaton of the other
        for values, kind in zip(labelled, self.kinds, strict=True):
            halves = values[::2], values[1::2]
            tries = [(kind, values)] + [(Automaton(fit), held) for fit, held in (halves, halves[::-1]) if fit and held]
            scored += [(v, x) for own, held in tries for v in held if (x := own.score(v, strict=True)) > -math.inf]
        for last in (False, False, False, True) if scored else ():
            ratios = sorted((x - self.ordinary(v)) / len(v) for v, x in scored)
            low = min(0.0, max(LOW_RATIO, ratios[int(LOW_SHARE * len(ratios))] - LOW_SLACK))
            self.plain = Automaton([v for v in background if self.ratio(v) <= (LEAST_RATIO if last else low * len(v))] or ["-"])

    def ratio(self, value: str) -> float:
        """Of the best format that accepts the run, against ordinary runs."""
        best = max((a.score(value, strict=True) for a in self.kinds), default=-math.inf)
        return best - self.ordinary(value) if best > -math.inf else best

    def ordinary(self, value: str) -> float:
        """Under the automaton of ordinary runs or, for numbers with their signs, under a uniform choice of those characters."""
        own = self.plain.score(value)
        return max(own, -len(value) * math.log(13)) if NUMBER.fullmatch(value) else own

    def is_credential(self, value: str) -> bool:
        return bool(self.kinds) and self.ratio(value) > LEAST_RATIO


def fit_formats(scanned: DataFrame) -> Formats:
    """Infer the automata from a bounded sample: of each kind the values with the smallest hashes, and so for other runs."""
    values = scanned.select(F.explode("_values").alias("v")).select("v.kind", "v.value")
    runs = scanned.select(F.lit(-1).alias("kind"), F.explode("_runs").alias("v")).select("kind", "v.value")

    def sample(df, n):
        fit = df.where(F.char_length("value") <= SAMPLE_CHARS).distinct()
        return [r[0] for r in fit.orderBy(F.xxhash64("value"), "value").limit(n).select("value").collect()]

    return Formats({k: sample(values.where(F.col("kind") == k), SAMPLE_VALUES) for k in range(3)}, sample(runs, SAMPLE_BACKGROUND))


@shielded
def find_secrets(docs: DataFrame, text: str = "text", formats: Formats | None = None) -> DataFrame:
    """Add ``spans``: secrets of each whole text as (start, end, kind), code points, end exclusive.

    Kinds 0 to 2 are the base patterns, leftmost and not overlapping per kind, and always stay. Kind 3 are further runs of
    16 or more credential characters whose likelihood under an automaton of a credential format is above that of ordinary
    runs by LEAST_RATIO; runs that overlap a base span are not added. Without ``formats`` they are inferred from the
    values that the base patterns found in ``docs``; if these hold none, only base spans come back. Null or empty text has
    no spans. Other columns but the text pass through; repeated rows are scanned each for itself.

    The texts are read once: spans, values and candidate runs are written to the shared folder, and the automata score
    these.
    """
    path = fresh_path(docs.sparkSession, "secrets")
    scanned = per_text(without(docs, "spans"), text, {"_base": SPAN, "_values": "array<struct<kind:int,value:string>>", "_runs": FOUND},
                       _scan, keep_text=False)
    scanned.write.parquet(path)
    scanned = docs.sparkSession.read.schema(scanned.schema).parquet(path)
    model = formats or fit_formats(scanned)

    def add(batches):
        import pyarrow as pa

        for b in batches:
            out = [[r for r in runs if model.is_credential(r["value"])] for runs in b.column("_runs").to_pylist()]
            more = pa.array([[{"start": r["start"], "end": r["end"], "kind": 3} for r in runs] for runs in out],
                            pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*b.columns, more], names=[*b.schema.names, "_more"])

    cols = [c for c in scanned.columns if not c.startswith("_")]
    schema = scanned.select("*", F.lit(None).cast(SPAN).alias("_more")).schema
    scored = scanned.mapInArrow(add, schema)
    spans = F.array_sort(F.concat("_base", "_more"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    return scored.select(*cols, spans.alias("spans"))


def is_kind(kind: int):
    return lambda span: span["kind"] == kind


def spans_text(spans):
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
