"""Joining rows to the incidents whose time range covers them: ranges are made disjoint first, so a row meets one entry at most."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opslake.plans.keys import null_safe_join
from opslake.plans.ordering import running_totals
from opslake.plans.sizing import BROADCAST_ROWS, broadcast_if_small, has_at_most, settle

#: Cells into which the span of the rows is cut, entries that a cell may hold before it is cut finer, and how fine at most (as a power of two).
CELLS, CROWD, FINEST = 1024, 32, 20
#: Rows of one cell per salt of a merge join.
SALT_ROWS = 1_000_000
#: Ranges so few that their intervals are made in one go.
FEW_RANGES = 2_000


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def elementary_intervals(ranges: DataFrame, by: Sequence[str], values: dict[str, Column], mode: str = "auto") -> DataFrame:
    """Disjoint intervals ``[a, b)`` per key over which the same ranges ``[a, b)`` hold, with the maximum of each value over these ranges.

    A sweep over the borders numbers the elementary intervals between them; a range covers a run of these numbers, which falls
    into at most two dyadic blocks per level. Each block keeps the maxima of its ranges, and each elementary interval takes
    the maxima of the blocks that hold it. So n ranges that all overlap give n log n small rows, never pairs. Intervals that no range covers are left out; empty ranges count for nothing.
    """
    by = list(by)
    some = ranges.where(F.col("a") < F.col("b")).groupBy(*by, "a", "b").agg(*[F.max(v).alias(n) for n, v in values.items()])
    few = has_at_most(some, FEW_RANGES)
    some = some if few else settle(some, "ranges")
    borders = some.select(*by, F.explode(F.array("a", "b")).alias("at")).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    numbered = running_totals(borders, by, ["at"], {"e": "_one"}, "plain" if few and mode == "auto" else mode).select(*by, "at", "e", "e_total")
    numbered = numbered if few else settle(numbered, "borders")
    start, end = (numbered.select(*by, F.col("at").alias(c), F.col("e").alias(f"_{c}")) for c in ("a", "b"))
    placed = null_safe_join(null_safe_join(some, start, [*by, "a"]), end, [*by, "b"])
    most = 2 * FEW_RANGES if few else numbered.agg(F.max("e_total")).first()[0] or 1
    levels = int(most).bit_length()

    def blocks(k: Column) -> Column:
        left = F.expr("shiftright(_a + shiftleft(1L, _k) - 1, _k)")
        right = F.expr("shiftright(_b, _k)")
        odd = lambda c: F.pmod(c, F.lit(2)) == 1
        return F.array(F.when((left < right) & odd(left), left), F.when((left < right) & odd(right), right - 1))

    leveled = placed.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    held = leveled.withColumn("_block", F.explode(F.array_compact(blocks(F.col("_k"))))).groupBy(*by, "_k", "_block").agg(
        *[F.max(n).alias(n) for n in values])
    next_ = numbered.select(*by, (F.col("e") - 1).alias("e"), F.col("at").alias("b"))
    each = null_safe_join(numbered.select(*by, "e", F.col("at").alias("a")), next_, [*by, "e"])
    up = each.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_block", F.expr("shiftright(e, _k)"))
    met = null_safe_join(up, F.broadcast(held) if few else broadcast_if_small(held), [*by, "_k", "_block"])
    return met.groupBy(*by, "a", "b").agg(*[F.max(n).alias(n) for n in values])


def attach_max(rows: DataFrame, ranges: DataFrame, on_service: bool, values: dict[str, Column], width: int | None = None,
               until_open: bool = False, max_rows: int = BROADCAST_ROWS, mode: str = "auto") -> DataFrame:
    """Add to each row the maximum of each value over the ranges that cover its timestamp, or null where none does.

    ``ranges`` has ``from_ts`` and ``to_ts`` (and ``service`` when ``on_service``) besides what ``values`` reads; ends are
    closed, or open with ``until_open``. Ranges are clipped to the span of the rows and made disjoint, so that a row meets one
    entry at most and is neither multiplied nor regrouped. Entries and rows meet in cells of time (``width`` seconds, by
    default a share of the span); a cell with many entries is cut into as many finer ones as it takes, so a row is held against few.
    Entries are broadcast only if counted to be few; else a merge join, in which cells with many rows, as counted, are salted.
    """
    ts = _micros(F.col("timestamp"))
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    if low is None:
        low, high = 0, 0
    step = width * 1_000_000 if width else max(1_000_000, -(-(high - low + 1) // CELLS))
    by = ["service"] if on_service else []
    begin, end = _micros(F.col("from_ts")), _micros(F.col("to_ts")) + (0 if until_open else 1)
    clipped = ranges.withColumn("a", F.greatest(begin, F.lit(low))).withColumn("b", F.least(end, F.lit(high + 1))).where(begin.isNotNull() & end.isNotNull())
    entries = elementary_intervals(clipped, by, values, mode)
    cell = lambda c: ((c - low - F.pmod(c - low, F.lit(step))) / step).cast("bigint")
    pieces = entries.withColumn("_cell", F.explode(F.sequence(cell(F.col("a")), cell(F.col("b") - 1))))
    pieces = settle(pieces.select(*by, "_cell", "a", "b", *values), "pieces")
    small = has_at_most(pieces, max_rows)
    cut = F.least(F.lit(FINEST), F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / F.lit(CROWD))))).cast("int")
    cells = pieces.groupBy(*by, "_cell").agg(cut.alias("_cut"))
    keys = [*by, "_cell", "_fine"]
    placed = rows.withColumn("_cell", cell(ts))
    if not small:
        n = placed.groupBy(*by, "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS)).alias("_salts"))
        cells = cells.join(n, [*by, "_cell"], "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
        keys.append("_salt")
    side = (lambda d: F.broadcast(d)) if small else (lambda d: d.hint("merge"))
    # The same rising function for rows and entries, so rounding does not matter.
    fine = lambda c: F.floor((c - low - F.col("_cell") * step).cast("double") * F.expr("shiftleft(1L, _cut)") / step)
    first = F.greatest(F.col("a"), F.col("_cell") * step + low)
    last = F.least(F.col("b"), (F.col("_cell") + 1) * step + low) - 1
    index = pieces.join(side(cells), [*by, "_cell"]).withColumn("_fine", F.explode(F.sequence(fine(first), fine(last))))
    met = placed.join(side(cells), [*by, "_cell"], "left").withColumn("_fine", fine(ts))
    if not small:
        index = index.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)))
        met = met.withColumn("_salt", F.pmod(F.xxhash64("timestamp", "service"), F.col("_salts")))
    index = index.select(*[F.col(k).alias(f"_r{k}") for k in keys], F.col("a").alias("_from"), F.col("b").alias("_to"), *values)
    on = [F.col(k) == F.col(f"_r{k}") for k in keys]
    joined = met.join(side(index), [*on, (ts >= F.col("_from")) & (ts < F.col("_to"))], "left")
    return joined.select(*rows.columns, *values)
