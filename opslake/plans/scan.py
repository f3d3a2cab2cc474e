"""Recurrences without a finite lookback, as a scan of maps that compose."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslake.plans.keys import null_safe_join
from opslake.plans.ordering import running_totals
from opslake.plans.sizing import settle

#: Rows of a block; a block is what one window group holds.
BLOCK = 32


def affine_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], maps: dict[str, tuple[Column, Column]], mode: str = "auto") -> DataFrame:
    """Add the states ``s = factor * s + term``, from 0 on, along ``order`` (unique within a key), for ``{name: (factor, term)}``.

    Such maps compose to maps of the same kind. Rows are numbered per key and cut into blocks of BLOCK; within a block the
    maps up to each row are composed, the map of a whole block is a row of the next level, and so on until a key has one
    block. The state before a block then comes down from the level above by a join on (key, block). So a key of any length
    is spread over blocks, and n rows take log n levels of ever fewer rows. Factors and terms must not be null.
    """
    keys, order, names = list(keys), list(order), list(maps)
    # The rows carry everything; levels above them carry the maps alone.
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    numbered = running_totals(one, keys, order, {"_pos": "_one"}, mode).drop("_one", "_pos_total")
    level = numbered.select(*keys, "_pos", *[c for n, (f, t) in maps.items() for c in (f.cast("double").alias(f"_f_{n}"), t.cast("double").alias(f"_t_{n}"))],
                            F.struct(*[c for c in df.columns if c not in keys], F.lit(0).alias("_")).alias("_row"))
    levels = []
    while True:
        upto = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = level.withColumn("_block", ((F.col("_pos") - 1 - F.pmod(F.col("_pos") - 1, F.lit(BLOCK))) / BLOCK).cast("bigint"))
        lists = cut.select(*keys, "_pos", "_block", *(["_row"] if not levels else []), *[
            F.collect_list(F.struct(F.col(f"_f_{n}").alias("f"), F.col(f"_t_{n}").alias("t"))).over(upto).alias(f"_l_{n}") for n in names])
        composed = lists.select(*keys, "_pos", "_block", *(["_row"] if not levels else []), *[c for n in names for c in (
            F.aggregate(f"_l_{n}", F.lit(1.0), lambda p, m: p * m["f"]).alias(f"_f_{n}"),
            F.aggregate(f"_l_{n}", F.lit(0.0), lambda s, m: m["f"] * s + m["t"]).alias(f"_t_{n}"))])
        levels.append(settle(composed, "scan"))
        if levels[-1].where("_block > 0").isEmpty():
            break
        last = levels[-1].groupBy(*keys, "_block").agg(F.max(F.struct("_pos", *[f"_{x}_{n}" for n in names for x in "ft"])).alias("m"))
        level = last.select(*keys, (F.col("_block") + 1).alias("_pos"), *[F.col(f"m._{x}_{n}").alias(f"_{x}_{n}") for n in names for x in "ft"])
    states = None
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth]
        if states is None:
            full = here.select("*", *[F.col(f"_t_{n}").alias(f"_s_{n}") for n in names])
        else:
            before = states.select(*keys, F.col("_pos").alias("_block"), *[F.col(f"_s_{n}").alias(f"_c_{n}") for n in names])
            joined = null_safe_join(here, before, [*keys, "_block"], "left")
            full = joined.select(*here.columns, *[(F.col(f"_t_{n}") + F.col(f"_f_{n}") * F.coalesce(f"_c_{n}", F.lit(0.0))).alias(f"_s_{n}") for n in names])
        states = full
    return states.select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns], *[F.col(f"_s_{n}").alias(n) for n in names])
