"""Size checks that decide between the one-exchange plan and the spread-out plan."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

# An input below this size may sit in one task even if a single key holds all of it.
SMALL_INPUT_BYTES = 64 << 20
# Rows a side may have before it is no longer broadcast.
BROADCAST_ROWS = 200_000


def input_bytes(df: DataFrame) -> int | None:
    """Sum of the sizes of the plan's leaves as Catalyst knows them; no job is run.

    None means the size cannot be known here, which callers treat as large.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    except Exception:
        return None
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def fits_one_task(df: DataFrame, limit: int = SMALL_INPUT_BYTES) -> bool:
    size = input_bytes(df)
    return size is not None and size <= limit


def use_spread_plan(df: DataFrame, mode: str) -> bool:
    if mode not in ("auto", "plain", "spread"):
        raise ValueError(f"unknown mode {mode!r}")
    return mode == "spread" or (mode == "auto" and not fits_one_task(df))


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Count up to the limit, no further."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side only after counting that it has at most ``max_rows`` rows.

    Above that the side is left to a sort-merge join, so nothing that grows with the data is shipped to every executor.
    """
    return F.broadcast(df) if has_at_most(df, max_rows) else df.hint("merge")


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write the frame once to the shared folder and read it back, so that several passes do not repeat its work.

    A frame that is only a scan with projections and filters is returned as it is: reading it again is as cheap.
    """
    from opslake.session import fresh_path

    if is_plain_scan(df):
        return df
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_plain_scan(df: DataFrame) -> bool:
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    except Exception:
        return False
    return re.search(r"^[\s:+\-|]*(Aggregate|Join|Window|Sort|Generate|Repartition\w*|Expand)\b", plan, re.M) is None
