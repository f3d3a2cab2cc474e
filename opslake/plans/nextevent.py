"""The first event at or after each of many points in time."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from opslake.plans.intervals import _micros
from opslake.plans.keys import null_safe_join
from opslake.plans.sizing import broadcast_if_small

#: Cells of time into which the span of the events is cut.
CELLS = 4096


def next_event(points: DataFrame, events: DataFrame, at: str, by: Sequence[str], out: str = "next_event", when: str = "timestamp") -> DataFrame:
    """Add to each point the time of the first event of its key at or after ``at``, or null where there is none.

    Points and events stand in one frame per key and cell of time, ordered by time, a point before events of its own
    instant, so that one window gives each point the next event of its cell; points behind the last one take the first
    event of the key's next cell that has any, from a table with one row per key and cell. Each row is read once and none is
    multiplied, however many points and events a key has. Null times of points give null; null keys are a key.
    """
    by = list(by)
    times = events.where(F.col(when).isNotNull()).select(*by, F.col(when).alias("_event")).distinct()
    low, high = times.agg(F.min(_micros(F.col("_event"))), F.max(_micros(F.col("_event")))).first()
    kind = events.schema[when].dataType
    if low is None:
        return points.withColumn(out, F.lit(None).cast(kind))
    step = (high - low) // CELLS + 1

    def cell(c):
        x = F.least(F.greatest(_micros(c), F.lit(low)), F.lit(high)) - low
        return ((x - F.pmod(x, F.lit(step))) / step).cast("bigint")

    packed = points.select(*by, F.col(at).alias("_at"), F.struct(*points.columns).alias("_point"))
    both = packed.withColumn("_event", F.lit(None).cast(kind)).unionByName(
        times.withColumn("_at", F.col("_event")).withColumn("_point", F.lit(None).cast(packed.schema["_point"].dataType)))
    ahead = Window.partitionBy(*by, "_cell").orderBy("_at", F.col("_event").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = both.withColumn("_cell", cell(F.col("_at"))).withColumn("_next", F.min("_event").over(ahead)).where(F.col("_point").isNotNull())
    firsts = times.withColumn("_cell", cell(F.col("_event"))).groupBy(*by, "_cell").agg(F.min("_event").alias("_first"))
    # A point's cell may hold no event, so the carry is looked up by the cells that points have.
    asked = met.where(F.col("_next").isNull() & F.col("_at").isNotNull()).select(*by, "_cell").distinct().withColumn("_first", F.lit(None).cast(kind))
    later = Window.partitionBy(*by).orderBy("_cell").rangeBetween(1, Window.unboundedFollowing)
    carry = firsts.unionByName(asked).withColumn("_carry", F.min("_first").over(later)).where(F.col("_first").isNull()).drop("_first")
    joined = null_safe_join(met, broadcast_if_small(carry), [*by, "_cell"], "left")
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_next", "_carry"))
    return joined.select(*[F.col("_point").getField(c).alias(c) for c in points.columns], found.alias(out))
