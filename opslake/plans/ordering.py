"""Exact global order work: running totals, quantiles and order statistics without one-task sorts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslake.plans.keys import null_safe_join
from opslake.plans.sizing import use_spread_plan
from opslake.session import fresh_path


def running_totals(df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: dict[str, str],
                   mode: str = "auto") -> DataFrame:
    """Add inclusive running sums and group totals: for ``sums={"cum": "n"}`` the columns ``cum`` and ``cum_total``.

    ``order`` must be unique within a group. The spread plan range-partitions by (group, order), fixes the partition
    numbers in a table in the shared folder, sums per partition, and adds the sums of earlier partitions; a group of any
    size is spread over as many partitions as it needs.
    """
    groups, order = list(groups), list(order)
    if not use_spread_plan(df, mode):
        whole = Window.partitionBy(*groups)
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(c).over(upto).alias(o) for o, c in sums.items()],
                         *[F.sum(c).over(whole).alias(f"{o}_total") for o, c in sums.items()])

    spark = df.sparkSession
    path = fresh_path(spark, "ranged")
    df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    sized = parts.groupBy(*groups, "_part").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select(
        *groups, "_part",
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
        *[F.sum(f"_s_{o}").over(whole).alias(f"{o}_total") for o in sums],
    )
    upto = Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = null_safe_join(parts, offsets, [*groups, "_part"])
    return joined.select(
        *df.columns,
        *[(F.sum(c).over(upto) + F.col(f"_o_{o}")).alias(o) for o, c in sums.items()],
        *[F.col(f"{o}_total") for o in sums],
    )


def quantile_from_totals(value: str, cum: str, prob: float) -> Column:
    """Aggregate: linear-interpolated quantile over value counts with running total ``cum``.

    Position p*(n-1) lies between two order statistics; each is the least value whose running total exceeds its rank.
    """
    at = F.col(f"{cum}_total").cast("double") - 1.0
    pos = at * F.lit(prob)
    low = F.min(F.when(F.col(cum) > F.floor(pos), F.col(value)))
    high = F.min(F.when(F.col(cum) > F.ceil(pos), F.col(value)))
    frac = F.max(pos - F.floor(pos))
    return F.when(low == high, low).otherwise(low + (high - low) * frac)


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float],
              mode: str = "auto") -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probs``; nulls are ignored."""
    groups = list(groups)
    present = df.where(F.col(value).isNotNull())
    if not use_spread_plan(df, mode):
        names = list(probs)
        packed = present.groupBy(*groups).agg(
            F.percentile(value, F.array(*[F.lit(probs[n]) for n in names])).alias("_q"))
        return packed.select(*groups, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    counts = present.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(counts, groups, [value], {"_cum": "_c"}, mode="spread")
    return ranked.groupBy(*groups).agg(*[quantile_from_totals(value, "_cum", p).alias(n) for n, p in probs.items()])


def position_cutoffs(df: DataFrame, order: Sequence[str], positions: dict[str, Column], mode: str = "auto") -> DataFrame:
    """One row, one struct: per entry, the ``order`` struct found at a 1-based position given in terms of ``_total``."""
    ranked = running_totals(df.select(*order).withColumn("_one", F.lit(1)), [], order, {"_rank": "_one"}, mode)
    key = F.struct(*[F.col(c) for c in order])
    return ranked.withColumn("_total", F.col("_rank_total")).agg(
        F.struct(*[F.max(F.when(F.col("_rank") == p, key)).alias(n) for n, p in positions.items()]).alias("cuts"))
