"""Streaming operators run to the end of their source, held against the batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.lines import col, fold, to_sql
from barloom.sources.shared import own_folder
from barloom.sources.views import TICKS_SQL
from barloom.streaming import bars as S


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a stream of files; times get the session's zone, which only moves labels there and back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id")


def _finished(spark: SparkSession, df: DataFrame) -> DataFrame:
    return S.run_to_end(df, own_folder(spark, "stream"))


def q_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that the watermark, ten minutes behind the last tick, has closed."""
    bars = _finished(spark, S.stream_bars(_ticks(spark, sf_dir), 60))
    return bars.select("symbol", F.col("dt").cast("timestamp_ntz").alias("dt"), *(F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")))


_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"
_STEP = 3_600_000_000
_BARS_SQL = f"SELECT symbol, make_timestamp(((epoch_us(ts) + {_STEP - 1}) // {_STEP}) * {_STEP}) AS dt, round(arg_min(price, (ts, event_id)), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, (ts, event_id)), 6) AS close, round(sum(volume), 6) AS volume FROM ({TICKS_SQL}) GROUP BY ALL"
_BARS_SQL = f"SELECT * FROM ({_BARS_SQL.replace('GROUP BY ALL', 'GROUP BY 1, 2')}) WHERE dt <= {_CLOSED.replace('max(ts)', 'max(ts) - INTERVAL 1 MICROSECOND')}"


def q_stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir).select("symbol", F.col("ts").alias("dt"), F.col("price").alias("close"))
    out = _finished(spark, S.stream_ema(ticks, 20))
    return out.groupBy("symbol").agg(F.count("ema").alias("n"), F.round(F.max_by("ema", "dt"), 6).alias("last_ema"))


def q_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _finished(spark, S.stream_sessions(_ticks(spark, sf_dir), "30 minutes"))
    return out.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), "n")


_SESSIONS_SQL = f"SELECT symbol, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(far) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT symbol, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS far FROM ({TICKS_SQL}))) GROUP BY symbol, e HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}"


_EMA_SQL = to_sql(f"SELECT symbol, ts AS dt, price AS close, event_id FROM ({TICKS_SQL})", {"ema": fold("Ema", col("close"), params=(20, 2 / 21))}, "symbol, dt, event_id, ema", order="dt, event_id")
_EMA_SQL = f"SELECT symbol, count(ema) AS n, round(arg_max(ema, dt), 6) AS last_ema FROM ({_EMA_SQL}) GROUP BY symbol"


def streaming_queries() -> dict:
    return {"stream_bars": (q_stream_bars, _BARS_SQL), "stream_ema": (q_stream_ema, _EMA_SQL), "stream_sessions": (q_stream_sessions, _SESSIONS_SQL)}
