"""Bars and folds on Structured Streaming: the batch operators' meaning, closed by a watermark instead of an end of data.

A row that is later than `late` is dropped; an earlier late row joins its bar as long as that is open, which is when bars
take late data. Bars are sent once, when the watermark has passed their end, so the clock of the stream closes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Ticks (symbol, ts timestamp, price, volume, event_id) as bars of `minutes`, closed and labelled at the right edge.

    Windows of the engine are closed at the left: times are moved back by a microsecond, so that a tick on an edge closes its bar.
    """
    moved = ticks.withColumn("_t", F.col("ts") - F.expr("INTERVAL '0.000001' SECOND")).withWatermark("_t", late)
    order = F.struct("ts", "event_id")
    out = moved.groupBy("symbol", F.window("_t", f"{minutes} minutes").alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.end").alias("dt"), "open", "high", "low", "close", "volume")


def stream_ema(bars: DataFrame, period: int, idle_minutes: int | None = None) -> DataFrame:
    """An exponential mean of every symbol's closes, seeded with the mean of the first `period`; state is three numbers a symbol.

    Rows of one trigger are put in order; rows of a later trigger are later bars.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    alpha = 2.0 / (1 + period)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, value = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("dt")
        out = []
        for x in rows["close"]:
            n += 1
            if n <= period:
                total += x
                value = total / n
            else:
                value = value * (1 - alpha) + x * alpha
            out.append(value if n >= period else None)
        state.update((n, total, value))
        if idle_minutes:
            state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame({"symbol": rows["symbol"], "dt": rows["dt"], "close": rows["close"], "ema": pd.Series(out, index=rows.index, dtype="float64")})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_minutes else GroupStateTimeout.NoTimeout
    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, dt timestamp, close double, ema double", "n long, total double, value double", "append", timeout)


def stream_sessions(rows: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Clusters of rows (symbol, ts) without a gap: symbol, start, end, n."""
    w = F.session_window("ts", gap)
    return rows.withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg(F.count("*").alias("n")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_end(df: DataFrame, folder: str) -> DataFrame:
    """Runs a stream in append mode over what its source has now and returns what it wrote: Parquet files in `folder`, which
    driver and executors share. What the watermark hasn't closed yet stays in the stream's state, for the next run."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
