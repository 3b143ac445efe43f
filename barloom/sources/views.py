"""Bars from the test tables: the same view as a DataFrame and as SQL.

bars(symbol, dt, open, high, low, close, volume, openinterest); ties within a bar are broken by a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["symbol", "dt", "open", "high", "low", "close", "volume", "openinterest"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bars(ticks: DataFrame, symbol: Column, dt: Column, price: Column, volume: Column, order: list[Column]) -> DataFrame:
    """One bar for each symbol and dt: first, highest, lowest and last price in `order`, and summed volume. One shuffle, combined before it."""
    by = F.struct(*order) if len(order) > 1 else order[0]
    own = ticks.select(symbol.alias("symbol"), dt.alias("dt"), price.cast("double").alias("price"), volume.cast("double").alias("v"), by.alias("o"))
    return own.groupBy("symbol", "dt").agg(F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"), F.sum("v").alias("volume"), F.lit(0.0).alias("openinterest"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of `events`: symbol, ts, price, volume 1, and the tie-breaking event_id."""
    return read_table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id")


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return to_bars(t, F.col("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.col("price"), F.col("volume"), [F.col("ts"), F.col("event_id")])


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices by priority."""
    t = read_table(spark, sf_dir, "orders")
    return to_bars(t, F.col("o_orderpriority"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"), F.col("o_totalprice"), F.lit(1.0), [F.col("o_orderkey")])


def bars_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices by return flag, with quantities as volume."""
    t = read_table(spark, sf_dir, "lineitem")
    return to_bars(t, F.col("l_returnflag"), F.date_trunc("day", "l_shipdate").cast("timestamp_ntz"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), [F.col("l_orderkey"), F.col("l_linenumber")])


def _sql(symbol: str, dt: str, price: str, volume: str, order: str, source: str) -> str:
    return (
        f"SELECT {symbol} AS symbol, {dt} AS dt, arg_min(({price})::DOUBLE, {order}) AS open, max(({price})::DOUBLE) AS high, min(({price})::DOUBLE) AS low, "
        f"arg_max(({price})::DOUBLE, {order}) AS close, sum(({volume})::DOUBLE) AS volume, 0::DOUBLE AS openinterest FROM {source} GROUP BY 1, 2"
    )


TICKS_SQL = "SELECT event_type AS symbol, ts, value AS price, 1::DOUBLE AS volume, event_id FROM events"
HOURLY_SQL = _sql("event_type", "CAST(date_trunc('hour', ts) AS TIMESTAMP)", "value", "1", "(ts, event_id)", "events")
ORDERS_SQL = _sql("o_orderpriority", "CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)", "o_totalprice", "1", "o_orderkey", "orders")
LINES_SQL = _sql("l_returnflag", "CAST(date_trunc('day', l_shipdate) AS TIMESTAMP)", "l_extendedprice / l_quantity", "l_quantity", "(l_orderkey, l_linenumber)", "lineitem")
VIEWS = {"hourly": (bars_hourly, HOURLY_SQL), "orders": (bars_orders, ORDERS_SQL), "lines": (bars_lines, LINES_SQL)}
