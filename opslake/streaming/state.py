"""Trailing z-score with the last rows of each service in keyed state."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opslake.operators.zscore import ZScoreConfig, flagged
from opslake.streaming.run import run_to_table


def trailing_z(past: np.ndarray, values: np.ndarray, config: ZScoreConfig) -> np.ndarray:
    """Absolute z-scores of ``values`` (rows x metrics, in order of time) against the ``window`` rows before each; NaN is null.

    Means and deviations are updated value by value from the oldest row on, as the engine's window aggregates are, so that
    results are the same to the last bit. All rows take a step of the window together.
    """
    window, rows = config.window, len(values)
    blank = np.full((window - len(past), values.shape[1]), np.nan)
    whole = np.concatenate((blank, past, values))
    count, total, mean, spread = (np.zeros(values.shape) for _ in range(4))
    with np.errstate(all="ignore"):
        for lag in range(window):
            x = whole[lag:lag + rows]
            there = ~np.isnan(x)
            n = count + 1
            delta = x - mean
            step = delta / n
            spread = np.where(there, spread + delta * (delta - step), spread)
            mean = np.where(there, mean + step, mean)
            total = np.where(there, total + x, total)
            count = np.where(there, n, count)
        z = np.abs(values - total / count) / (np.sqrt(spread / count) + config.epsilon)
    return np.where((count >= config.min_history) & ~np.isnan(z), z, 0.0)


def _scorer(metrics: list[str], config: ZScoreConfig, ttl_days: int | None):
    """Per service, the state is the newest ``window`` rows: their times in microseconds and their values, row by row.

    Rows at or before the newest time have come too late; they leave as they came, marked, and change nothing.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat([p[["timestamp", *metrics]] for p in rows], ignore_index=True).sort_values("timestamp", kind="stable", ignore_index=True)
        at = new["timestamp"].to_numpy().astype("datetime64[us]")
        micros = at.astype(np.int64)
        times, past = (np.array(x) for x in state.get) if state.exists else (np.empty(0, np.int64), np.empty(0))
        past = past.astype(np.float64).reshape(len(times), len(metrics))
        on_time = ~np.isnat(at) & (micros > times[-1] if len(times) else True)
        values = new[metrics].to_numpy(np.float64)
        z = np.zeros(values.shape)
        z[on_time] = trailing_z(past, values[on_time], config)
        times, past = np.concatenate((times, micros[on_time])), np.concatenate((past, values[on_time]))
        if len(times):
            state.update((times[-config.window:].tolist(), past[-config.window:].ravel().tolist()))
            if ttl_days:
                state.setTimeoutDuration(ttl_days * 86_400_000)
        out = pd.DataFrame(z, columns=[f"{m}_z" for m in metrics])
        out.insert(0, "timestamp", new["timestamp"])
        out.insert(1, "service", pd.Series([key[0]] * len(new), dtype=object))
        yield out.assign(late=~on_time)

    return step


def keyed_zscores(telemetry: DataFrame, config: ZScoreConfig = ZScoreConfig(), ttl_days: int | None = None) -> DataFrame:
    """Stream of the columns of ``zscore_anomalies`` and ``late``, with the rows carried per service in the state store.

    State is versioned by batch, so a replayed batch starts from the state before it and a restart goes on where the last
    run ended; no tables of carried rows are left behind. With ``ttl_days`` the state of a service that sent nothing for so
    long is removed. That is for queries that keep running: Spark goes on with empty batches while such timeouts are
    pending, so an ``availableNow`` run would not end.

    A service's rows of one micro-batch are held by one task as numbers (8 bytes per metric and some copies): choose the
    batch by ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``. For a backlog in which one service holds a large part use
    ``detect.stream_zscores``, which spreads a service over time slices. Of rows with equal times any order may be taken, as
    in the batch operator. Null and NaN values count as absent; rows without a time come out as late; rows without a service
    form one group; an empty stream gives no rows.
    """
    metrics = [m for m in config.metrics if m in telemetry.columns]
    z = T.StructType([T.StructField("timestamp", T.TimestampNTZType()), T.StructField("service", T.StringType()),
                      *[T.StructField(f"{m}_z", T.DoubleType()) for m in metrics], T.StructField("late", T.BooleanType())])
    rows = telemetry.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "service", *[F.col(m).cast("double").alias(m) for m in metrics])
    states = rows.groupBy("service").applyInPandasWithState(
        _scorer(metrics, config, ttl_days), z, "times array<bigint>, past array<double>", "append",
        GroupStateTimeout.ProcessingTimeTimeout if ttl_days else GroupStateTimeout.NoTimeout)
    return flagged(states, metrics, config, ("late",))


def stream_zscores_by_state(telemetry: DataFrame, config: ZScoreConfig = ZScoreConfig(), out: str | None = None,
                            checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run over the available data; returns (scores, late rows), as ``detect.stream_zscores`` does.

    A further run with the same ``out`` and ``checkpoint`` adds what has come since.
    """
    done = run_to_table(keyed_zscores(telemetry, config), "append", out, checkpoint)
    return done.where("not late").drop("late"), done.where("late").select("timestamp", "service")
