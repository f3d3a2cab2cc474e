"""Distribution drift between a reference and a current table, for all features in one job."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import gcd, inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from opslake.operators.prep import long_values
from opslake.plans.ordering import quantile_from_totals, running_totals
from opslake.plans.sizing import settle
from opslake.schema import numeric_columns


@dataclass(frozen=True)
class DriftConfig:
    psi_warning: float = 0.1
    psi_drift: float = 0.2
    p_value: float = 0.05
    ks_warning: float = 0.1
    ks_drift: float = 0.2
    bins: int = 10
    floor: float = 1e-4


def compared_features(reference: DataFrame, current: DataFrame, features: Sequence[str] | None = None) -> tuple[list, list]:
    """(features on both sides, features missing on one side); numeric columns of either side unless listed."""
    wanted = list(features) if features is not None else sorted(
        {*numeric_columns(reference), *numeric_columns(current)})
    shared = [c for c in wanted if c in reference.columns and c in current.columns]
    return shared, [c for c in wanted if c not in shared]


def reference_counts(reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows per (feature, value), to be taken once for a reference that many tables are compared with."""
    return settle(long_values(reference, features).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n")), "reference")


def value_counts(reference: DataFrame, current: DataFrame, features: Sequence[str], mode: str = "auto",
                 counted: DataFrame | None = None) -> DataFrame:
    """Per (feature, value): rows of either side, with running and whole totals in value order; finite values only.

    ``counted`` are the reference's counts, if they were taken before.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    if counted is None:
        before = long_values(reference, features).select("feature", "value", one.alias("ref_n"), none.alias("cur_n"))
    else:
        before = counted.where(F.col("feature").isin(list(features))).select("feature", "value", F.col("n").alias("ref_n"), none.alias("cur_n"))
    sides = before.unionByName(long_values(current, features).select("feature", "value", none.alias("ref_n"), one.alias("cur_n")))
    counts = sides.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n"))
    return running_totals(counts, ["feature"], ["value"], {"cum_ref": "ref_n", "cum_cur": "cur_n"}, mode)


#: Rows of the larger side up to which the p-value of a feature is exact.
EXACT_ROWS = 10_000


def exact_ks_tail(d: float, n: int, m: int) -> float:
    """Probability that two samples of n and m rows from one distribution are at least d apart, counted over all their orders.

    An order is a path over a grid of n x m steps; the samples stay closer than d while the path stays in a band. Paths are
    counted by where they first leave the band, as each such step leaves a free path to the end; so small probabilities
    keep their digits. Rows of counts are rescaled, as they outgrow a double. One row of the grid is one running sum.
    """
    g = gcd(n, m)
    a, b = m // g, n // g
    h = round(d * a * n)
    if h <= 0:
        return 1.0
    if n > m:
        n, m, a, b = m, n, b, a
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + m + 1)))))
    total = logs[n + m] - logs[n] - logs[m]
    free = lambda i, j: logs[n - i + m - j] - logs[n - i] - logs[m - j]
    outside, scale = -inf, 0.0
    low, high = 0, min(m, (h - 1) // b)
    u = np.ones(high + 1)
    for i in range(n + 1):
        if high < m:  # the step to the right of the band's last cell
            outside = np.logaddexp(outside, scale + np.log(u[-1]) + free(i, high + 1))
        if i == n:
            break
        new_low, new_high = max(0, ((i + 1) * a - h) // b + 1), min(m, ((i + 1) * a + h - 1) // b)
        gone = min(max(0, new_low - low), len(u))
        if gone:  # steps up that leave the band on its left
            cells = np.arange(low, low + gone)
            with np.errstate(divide="ignore"):
                outside = np.logaddexp(outside, np.logaddexp.reduce(scale + np.log(u[:gone]) + free(i + 1, cells)))
        if new_low > high:
            break
        u = np.cumsum(np.concatenate((u[gone:], np.zeros(new_high - high))))
        low, high = new_low, new_high
        top = u[-1]
        u, scale = u / top, scale + np.log(top)
    return float(min(1.0, np.exp(outside - total)))


@F.pandas_udf(T.DoubleType())
def _exact_tail(stat: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Of a row per feature; features with a larger side than EXACT_ROWS are left to the asymptotic series."""
    def one(d, a, b):
        known = d == d and a == a and b == b and 0 < min(a, b) and max(a, b) <= EXACT_ROWS
        return exact_ks_tail(float(d), int(a), int(b)) if known else None

    return pd.Series([one(*row) for row in zip(stat, n, m, strict=True)], dtype="object").astype("float64")


def ks_p_value(stat: Column, n: Column, m: Column) -> Column:
    """Two-sided asymptotic Kolmogorov tail for the two-sample distance."""
    lam2 = stat * stat * F.try_divide(n * m, n + m)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k.cast("double") * k.cast("double") * lam2))
    tail = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * terms))
    return F.when(F.sqrt(lam2) < 0.2, F.lit(1.0)).otherwise(tail)


def feature_shape(counts: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """Per feature: sizes, ranges, KS distance and p-value (exact up to EXACT_ROWS rows a side), and the reference quantile edges, from one aggregation."""
    ref, cur = F.col("cum_ref_total"), F.col("cum_cur_total")
    gap = F.abs(F.try_divide(F.col("cum_ref"), ref) - F.try_divide(F.col("cum_cur"), cur))
    on_ref, on_cur = F.col("ref_n") > 0, F.col("cur_n") > 0
    edges = [quantile_from_totals("value", "cum_ref", i / config.bins).alias(f"_e{i}") for i in range(config.bins + 1)]
    agg = counts.groupBy("feature").agg(
        F.max(ref).alias("ref_count"), F.max(cur).alias("cur_count"),
        F.min(F.when(on_ref, F.col("value"))).alias("ref_min"), F.max(F.when(on_ref, F.col("value"))).alias("ref_max"),
        F.min(F.when(on_cur, F.col("value"))).alias("cur_min"), F.max(F.when(on_cur, F.col("value"))).alias("cur_max"),
        F.max(gap).alias("ks_statistic"), *edges)
    return agg.select(
        "feature", "ref_count", "cur_count", "ref_min", "ref_max", "cur_min", "cur_max", "ks_statistic",
        F.coalesce(_exact_tail(F.col("ks_statistic"), F.col("ref_count").cast("double"), F.col("cur_count").cast("double")),
                   ks_p_value(F.col("ks_statistic"), F.col("ref_count").cast("double"), F.col("cur_count").cast("double"))).alias("ks_p_value"),
        F.array_distinct(F.array(*[F.col(f"_e{i}") for i in range(config.bins + 1)])).alias("edges"))


def psi_values(counts: DataFrame, shape: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """``feature, psi``: bins [a, b) between the distinct reference quantiles, open at both ends; floored and renormalised.

    ``shape`` has one row per compared column, so it is broadcast. A constant reference gives 0 if the current side equals
    it everywhere, else 1; an empty side gives 0.
    """
    usable = shape.select("feature", "ref_count", "cur_count", "ref_min", "ref_max", "cur_min", "cur_max", "edges")
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = (
        counts.select("feature", "value", "ref_n", "cur_n")
        .join(F.broadcast(usable.select("feature", "ref_count", "cur_count", inner.alias("_inner"))), "feature")
        .withColumn("bin", F.size(F.filter("_inner", lambda e: e <= F.col("value"))))
        .groupBy("feature", "bin").agg(
            F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n"), F.max("ref_count").alias("ref_count"),
            F.max("cur_count").alias("cur_count"))
    )
    floor = F.lit(config.floor)
    share = binned.select("feature", F.greatest(F.try_divide("ref_n", "ref_count"), floor).alias("r"),
                          F.greatest(F.try_divide("cur_n", "cur_count"), floor).alias("c"))
    # Bins are few; with totals R and C, sum((c/C - r/R) * ln((c/C)/(r/R))) splits into sums that need no second pass.
    log = F.ln(F.col("c") / F.col("r"))
    sums = share.groupBy("feature").agg(
        F.sum("r").alias("R"), F.sum("c").alias("C"), F.sum(F.col("c") * log).alias("cl"), F.sum(F.col("r") * log).alias("rl"))
    psi = F.col("cl") / F.col("C") - F.col("rl") / F.col("R")
    constant = F.col("ref_min") == F.col("ref_max")
    same = (F.col("cur_min") == F.col("ref_min")) & (F.col("cur_max") == F.col("ref_min"))
    return usable.join(F.broadcast(sums), "feature", "left").select(
        "feature",
        F.when((F.col("ref_count") == 0) | (F.col("cur_count") == 0), F.lit(0.0))
        .when(constant, F.when(same, F.lit(0.0)).otherwise(F.lit(1.0)))
        .otherwise(psi).alias("psi"))


def feature_drift(reference: DataFrame, current: DataFrame, features: Sequence[str] | None = None,
                  config: DriftConfig = DriftConfig(), mode: str = "auto", counted: DataFrame | None = None) -> DataFrame:
    """``feature, status, psi, ks_statistic, ks_p_value, is_drift, is_warning, message`` for every compared feature."""
    shared, missing = compared_features(reference, current, features)
    spark = reference.sparkSession
    names = spark.range(1).select(F.explode(F.array(
        *[F.struct(F.lit(c).alias("feature"), F.lit(c in missing).alias("missing"), F.lit("current" if c in reference.columns else "reference").alias("_side")) for c in [*shared, *missing]])).alias("f")
    ).select("f.*")
    if shared:
        counts = settle(value_counts(reference, current, shared, mode, counted), "counts")
        shape = settle(feature_shape(counts, config), "shape")
        measured = shape.join(psi_values(counts, shape, config), "feature").drop("edges")
    else:
        measured = spark.createDataFrame([], (
            "feature string, ref_count bigint, cur_count bigint, ref_min double, ref_max double, cur_min double, "
            "cur_max double, ks_statistic double, ks_p_value double, psi double"))
    rows = names.join(measured, "feature", "left")
    empty = ~((F.coalesce("ref_count", F.lit(0)) > 0) & (F.coalesce("cur_count", F.lit(0)) > 0))
    constant = (F.col("ref_min") == F.col("ref_max")) & (F.col("cur_min") == F.col("cur_max"))
    equal = F.col("ref_min") == F.col("cur_min")
    psi, ks, p = F.col("psi"), F.col("ks_statistic"), F.col("ks_p_value")

    def over(psi_limit: float, ks_limit: float) -> Column:
        return (psi >= psi_limit) | ((p < config.p_value) & (ks >= ks_limit))

    status = (
        F.when(F.col("missing"), "MISSING").when(empty, "INSUFFICIENT_DATA")
        .when(constant, F.when(equal, "NO_DRIFT").otherwise("DRIFT"))
        .when(over(config.psi_drift, config.ks_drift), "DRIFT")
        .when(over(config.psi_warning, config.ks_warning), "WARNING").otherwise("NO_DRIFT")
    )

    def measure(value: Column, same: float, shifted: float) -> Column:
        return F.when(F.col("missing") | empty, F.lit(None).cast("double")).when(
            constant, F.when(equal, F.lit(same)).otherwise(F.lit(shifted))).otherwise(F.round(value, 4))

    # The sentences.
    said = F.format_string("(PSI=%.4f, KS=%.4f, p=%.4e)", psi, ks, p)
    message = (
        F.when(F.col("missing"), F.format_string("Feature '%s' missing from %s dataset.", "feature", "_side")).when(empty, "Feature contains no finite values.")
        .when(constant, F.when(equal, "Constant identical values across datasets.").otherwise("Constant value shifted completely."))
        .otherwise(F.concat(F.when(status == "DRIFT", "Significant drift ").when(status == "WARNING", "Moderate drift / warning ")
                            .otherwise("Distribution stable "), said)))
    judged = rows.select(
        "feature", message.alias("message"), status.alias("status"), measure(psi, 0.0, 1.0).alias("psi"),
        measure(ks, 0.0, 1.0).alias("ks_statistic"), measure(p, 1.0, 0.0).alias("ks_p_value"))
    return judged.select(*[c for c in judged.columns if c != "message"], F.col("status").isin("DRIFT", "MISSING").alias("is_drift"),
                         (F.col("status") == "WARNING").alias("is_warning"), "message")


def drift_report(verdicts: DataFrame, reference: DataFrame, current: DataFrame) -> DataFrame:
    """One row: table sizes, drifted and warning features, and the drifted share of the features checked."""
    names = (lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("feature")))))
    return verdicts.agg(
        F.count(F.lit(1)).alias("checked"), names("is_drift").alias("drifted_features"),
        names("is_warning").alias("warning_features"),
    ).withColumn("reference_count", reference.agg(F.count(F.lit(1))).scalar()).withColumn(
        "current_count", current.agg(F.count(F.lit(1))).scalar()).select(
        "reference_count", "current_count", "drifted_features", "warning_features",
        (F.size("drifted_features") > 0).alias("has_drift"),
        F.when(F.col("checked") > 0, F.round(F.size("drifted_features") / F.col("checked"), 4))
        .otherwise(F.lit(0.0)).alias("drift_share"))
