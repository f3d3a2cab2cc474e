"""Small column expressions shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

INF = float("inf")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """The value as double, or null when it is null, NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(INF)), d)


def is_infinite(c: Column) -> Column:
    return F.abs(c.cast("double")) == F.lit(INF)


def ratio(num: Column, den: Column) -> Column:
    """num / den, or 0 when the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def clip(c: Column, low: float | None, high: float | None) -> Column:
    if high is not None:
        c = F.least(c, F.lit(high))
    return c if low is None else F.greatest(c, F.lit(low))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def shift_seconds(ts: Column, seconds: float) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_timestamp(c: Column) -> Column:
    """Parse text (or pass timestamps through) to a UTC wall-clock timestamp; unparseable text gives null."""
    return F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")


def utc_time(df: DataFrame, name: str) -> Column:
    """A column of ``df`` as UTC wall-clock timestamp; only other types than timestamps go through text."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.col(name)
    return F.col(name).cast("timestamp_ntz") if kind == "timestamp" else utc_timestamp(F.col(name))


def greatest_of(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)
