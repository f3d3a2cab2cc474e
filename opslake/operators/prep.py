"""Splits, imputation and scaling for the models."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from opslake.functions.scalars import finite
from opslake.plans.ordering import position_cutoffs, quantiles


def chronological_split(df: DataFrame, train: float = 0.6, validation: float = 0.2, test: float = 0.2,
                        mode: str = "auto") -> DataFrame:
    """Add ``split`` (train, validation, test) by cutting the distinct timestamps at the given shares.

    The cut positions truncate ``n * share`` in double arithmetic; the two cut times are a scalar.
    """
    if not math.isclose(train + validation + test, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("split shares must sum to 1")
    total = F.col("_total").cast("double")
    n_train = F.greatest(F.lit(1), F.floor(total * F.lit(float(train))))
    n_val = F.greatest(F.lit(1), F.floor(total * F.lit(float(validation)))) if validation > 0 else F.lit(0)
    cuts = position_cutoffs(df.select("timestamp").distinct(), ["timestamp"],
                            {"_train_end": n_train, "_val_end": n_train + n_val}, mode)
    ts = F.col("timestamp")
    return (
        df.withColumn("_cuts", cuts.scalar())
        .withColumn("split", F.when(ts <= F.col("_cuts._train_end.timestamp"), "train")
                    .when(ts <= F.col("_cuts._val_end.timestamp"), "validation").otherwise("test"))
        .drop("_cuts")
    )


def positional_split(df: DataFrame, test: float, mode: str = "auto") -> DataFrame:
    """Add ``split`` (train, test) by row position in (timestamp, service) order."""
    n_train = F.greatest(F.lit(1), F.floor(F.col("_total").cast("double") * F.lit(1.0 - test)))
    cut = position_cutoffs(df, ["timestamp", "service"], {"_train_end": n_train}, mode)
    here = F.struct("timestamp", "service")
    return (
        df.withColumn("_cuts", cut.scalar())
        .withColumn("split", F.when(here <= F.col("_cuts._train_end"), "train").otherwise("test")).drop("_cuts")
    )


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): ``feature, value`` with value null unless finite."""
    doubles = df.select(*keep, *[finite(F.col(c)).alias(c) for c in columns])
    return doubles.unpivot(list(keep), list(columns), "feature", "value")


def scaler_stats(train: DataFrame, columns: Sequence[str], mode: str = "auto") -> DataFrame:
    """Per feature: exact median, then mean and population deviation after imputing with it (median of nothing is 0).

    Mean and deviation after imputation follow from the count, mean and spread of the present values, so one wide
    aggregation beside the quantiles is enough.
    """
    medians = quantiles(long_values(train, columns), ["feature"], "value", {"median": 0.5}, mode)
    zero = F.lit(0.0)
    sums = train.agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(F.count(finite(F.col(c))).alias("present"), F.coalesce(F.avg(finite(F.col(c))), zero).alias("avg"),
                 F.coalesce(F.var_pop(finite(F.col(c))), zero).alias("var")).alias(c) for c in columns])
    moments = sums.select("n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`.present").alias("present"), F.col(f"`{c}`.avg").alias("avg"),
                 F.col(f"`{c}`.var").alias("var")) for c in columns])))
    joined = moments.join(medians, "feature", "left").withColumn("median", F.coalesce("median", zero))
    share = F.col("present") / F.col("n")
    gap = F.col("avg") - F.col("median")
    return joined.select(
        "feature", "n", (F.col("n") - F.col("present")).alias("n_missing"), "median",
        (F.col("median") + share * gap).alias("mean"),
        F.sqrt(share * F.col("var") + share * (F.lit(1.0) - share) * gap * gap).alias("std"))


def scale(df: DataFrame, stats: Sequence) -> DataFrame:
    """Impute and scale the columns named by ``stats`` rows; a zero deviation divides by 1.

    ``stats`` holds one row per feature (a model parameter), so the values are literals in one projection.
    """
    by_name = {r["feature"]: r for r in stats}
    out = []
    for c in df.columns:
        if c in by_name:
            r = by_name[c]
            std = r["std"] or 1.0
            out.append(((F.coalesce(finite(F.col(c)), F.lit(float(r["median"]))) - F.lit(float(r["mean"])))
                        / F.lit(float(std))).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
