"""Joins on keys that may be null."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equally named columns where null meets null; still an equi-join. The left side's keys are kept."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(named[f"_r_{c}"]) for c in keys]
    return left.join(named, on, how).drop(*[f"_r_{c}" for c in keys])
