"""Readers of bar files. Every reader gives the columns of bars in declared types; nothing is inferred.

Dates stand for the end of the session unless a time is given. Rows with a broken number are read with a null there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_END = "23:59:59"
BARS = ["symbol", "dt", "open", "high", "low", "close", "volume", "openinterest"]


def _raw(spark: SparkSession, path, columns: int, header: bool, sep: str) -> DataFrame:
    schema = ", ".join(f"c{k} string" for k in range(columns))
    return spark.read.csv(path, schema=schema, header=header, sep=sep, enforceSchema=True, mode="PERMISSIVE")


def _number(c: Column, decimal_comma: bool = False) -> Column:
    return F.expr("try_cast(x as double)") if c is None else (F.regexp_replace(c, ",", ".") if decimal_comma else c).try_cast("double")


def _stamp(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def generic_csv(spark: SparkSession, path, symbol: str, dtformat: str = "yyyy-MM-dd HH:mm:ss", tmformat: str = "HH:mm:ss", datetime: int = 0, time: int = -1, open: int = 1, high: int = 2, low: int = 3, close: int = 4, volume: int = 5, openinterest: int = 6, header: bool = True, sep: str = ",", nullvalue: float | None = None, session_end: str = SESSION_END, extra: dict[str, int] | None = None) -> DataFrame:  # noqa: A002
    """Columns by position (-1: absent). dtformat: a date pattern, 'unix' (whole seconds) or 'unixfloat'. `extra` names further columns."""
    places = {"open": open, "high": high, "low": low, "close": close, "volume": volume, "openinterest": openinterest} | (extra or {})
    raw = _raw(spark, path, max(datetime, time, *places.values()) + 1, header, sep)
    day = F.col(f"c{datetime}")
    if dtformat in ("unix", "unixfloat"):
        dt = F.timestamp_add("MICROSECOND", F.round(day.try_cast("double") * 1_000_000).cast("long"), F.lit("1970-01-01").cast("timestamp_ntz"))
    elif time >= 0:
        dt = _stamp(F.concat_ws(" ", day, F.col(f"c{time}")), f"{dtformat} {tmformat}")
    elif any(c in dtformat for c in "Hh"):
        dt = _stamp(day, dtformat)
    else:
        dt = _stamp(F.concat_ws(" ", day, F.lit(session_end)), f"{dtformat} HH:mm:ss")
    value = lambda k: F.lit(nullvalue).cast("double") if k < 0 else F.coalesce(F.col(f"c{k}").try_cast("double"), F.lit(nullvalue).cast("double"))
    return raw.select(F.lit(symbol).alias("symbol"), dt.alias("dt"), *(value(k).alias(n) for n, k in places.items()))


def bar_csv(spark: SparkSession, path, symbol: str, header: bool = True, sep: str = ",") -> DataFrame:
    """Date[,Time],Open,High,Low,Close,Volume,OpenInterest: lines of 8 fields have a time."""
    raw = _raw(spark, path, 8, header, sep)
    timed = F.col("c7").isNotNull()
    pick = lambda k: F.when(timed, F.col(f"c{k + 1}")).otherwise(F.col(f"c{k}")).try_cast("double")
    dt = _stamp(F.concat_ws(" ", "c0", F.when(timed, F.col("c1")).otherwise(F.lit(SESSION_END))), "yyyy-MM-dd HH:mm:ss")
    return raw.select(F.lit(symbol).alias("symbol"), dt.alias("dt"), *(pick(k).alias(n) for k, n in enumerate(BARS[2:], 1)))


mt4_csv = partial(generic_csv, dtformat="yyyy.MM.dd", tmformat="HH:mm", datetime=0, time=1, open=2, high=3, low=4, close=5, volume=6, openinterest=-1, header=False)
sierra_csv = partial(generic_csv, dtformat="yyyy/MM/dd", tmformat="HH:mm:ss", datetime=0, time=1, open=2, high=3, low=4, close=5, volume=6, openinterest=-1)


def vchart_csv(spark: SparkSession, path) -> DataFrame:
    """ticker,timeframe(I/D/W/M),yyyyMMdd,time,O,H,L,C,V,OI: intraday lines have a time (HHmm), others stand at the session's end."""
    raw = _raw(spark, path, 10, False, ",")
    clock = F.when(F.col("c1") == "I", F.lpad("c3", 4, "0")).otherwise(F.lit("2359"))
    return raw.select(F.col("c0").alias("symbol"), _stamp(F.concat_ws(" ", "c2", clock), "yyyyMMdd HHmm").alias("dt"), *(F.col(f"c{k}").try_cast("double").alias(n) for k, n in enumerate(BARS[2:], 4)))


def yahoo_csv(spark: SparkSession, path, symbol: str, adjclose: bool = True, adjvolume: bool = True, round_: bool = True, decimals: int = 2, roundvolume: int | None = None, swapcloses: bool = False) -> DataFrame:
    """Date,Open,High,Low,Close,AdjClose,Volume: prices over, and volume times, close by adjusted close. Lines of nulls go; order doesn't matter."""
    raw = _raw(spark, path, 7, True, ",")
    n = lambda k: F.col(f"c{k}").try_cast("double")
    close, adjusted = (n(5), n(4)) if swapcloses else (n(4), n(5))
    factor = close / adjusted if adjclose else F.lit(1.0)
    fit = lambda c: F.round(c, decimals) if round_ else c
    volume = n(6) * factor if adjclose and adjvolume else n(6)
    dt = _stamp(F.concat_ws(" ", "c0", F.lit(SESSION_END)), "yyyy-MM-dd HH:mm:ss")
    out = raw.where(n(4).isNotNull() & n(5).isNotNull())
    return out.select(F.lit(symbol).alias("symbol"), dt.alias("dt"), *(fit(n(k) / factor).alias(c) for k, c in ((1, "open"), (2, "high"), (3, "low"))), fit(adjusted if adjclose else close).alias("close"), (F.round(volume, roundvolume) if roundvolume is not None else volume).alias("volume"), F.lit(0.0).alias("openinterest"), adjusted.alias("adjclose"))


yahoo_legacy_csv = yahoo_csv


def quandl_csv(spark: SparkSession, path, symbol: str, adjclose: bool = True, round_: bool = False, decimals: int = 2) -> DataFrame:
    """Date, six raw columns, split and dividend, then the same adjusted; the adjusted ones are read if `adjclose`."""
    raw, first = _raw(spark, path, 13, True, ","), 8 if adjclose else 1
    fit = lambda c: F.round(c, decimals) if round_ else c
    dt = _stamp(F.concat_ws(" ", "c0", F.lit(SESSION_END)), "yyyy-MM-dd HH:mm:ss")
    return raw.select(F.lit(symbol).alias("symbol"), dt.alias("dt"), *(fit(F.col(f"c{first + k}").try_cast("double")).alias(n) for k, n in enumerate(BARS[2:6])), F.col(f"c{first + 4}").try_cast("double").alias("volume"), F.lit(0.0).alias("openinterest"))


def minute_csv(spark: SparkSession, path, symbol: str, tail: int | None = None) -> DataFrame:
    """<DTYYYYMMDD>,<TIME>,<OPEN>..<VOL>: decimal commas are mended, broken rows go, of rows with one time the last line stays."""
    raw = _raw(spark, path, 7, True, ",").withColumn("_line", F.monotonically_increasing_id())
    dt = _stamp(F.concat_ws(" ", "c0", F.lpad("c1", 6, "0")), "yyyyMMdd HHmmss")
    out = raw.select(F.lit(symbol).alias("symbol"), dt.alias("dt"), *(_number(F.col(f"c{k}"), True).alias(n) for k, n in enumerate(BARS[2:7], 2)), F.lit(0.0).alias("openinterest"), "_line")
    out = out.dropna(subset=["dt", *BARS[2:6]])
    last = out.groupBy("symbol", "dt").agg(F.max_by(F.struct(*BARS[2:]), "_line").alias("r")).select("symbol", "dt", "r.*")
    return last.orderBy(F.desc("dt")).limit(tail) if tail else last


def frame(spark: SparkSession, pdf, symbol: str, columns: dict[str, str | int | None] | None = None, datetime: str | int | None = None) -> DataFrame:
    """A pandas frame: columns by name without case, by position, or absent (None); the index is the time unless `datetime` names a column."""
    names = {str(c).lower(): c for c in pdf.columns}
    given, out = columns or {}, {}
    for n in BARS[2:]:
        want = given.get(n, n)
        found = pdf.columns[want] if isinstance(want, int) else names.get(str(want).lower()) if want is not None else None
        out[n] = pdf[found].astype(float).to_numpy() if found is not None else [None] * len(pdf)
    times = pdf.index if datetime is None else pdf.iloc[:, datetime] if isinstance(datetime, int) else pdf[names[datetime.lower()]]
    table = pa.table({"symbol": [symbol] * len(pdf), "dt": pa.array(list(times.to_pydatetime() if hasattr(times, "to_pydatetime") else times), pa.timestamp("us"))} | {n: pa.array(v, pa.float64()) for n, v in out.items()})
    return spark.createDataFrame(table).withColumn("dt", F.col("dt").cast("timestamp_ntz"))


def rows(spark: SparkSession, iterable, symbol: str) -> DataFrame:
    """Any iterable of (dt, open, high, low, close, volume, openinterest)."""
    return spark.createDataFrame([(symbol, *r) for r in iterable], "symbol string, dt timestamp_ntz, open double, high double, low double, close double, volume double, openinterest double")


def binary_bars(spark: SparkSession, path, symbol: str, intraday: bool = False) -> DataFrame:
    """Binary records of a packed day (year * 500 + month * 32 + day), for intraday files minutes, four prices, volume and interest."""
    import struct

    form = "<IIffffII" if intraday else "<IffffII"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import datetime, timedelta

        size = struct.calcsize(form)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                out = []
                for r in struct.iter_unpack(form, raw[: len(raw) // size * size]):
                    year, rest = divmod(r[0], 500)
                    month, day = divmod(rest, 32)
                    at = datetime(year, month, day) + (timedelta(minutes=r[1]) if intraday else timedelta(hours=23, minutes=59, seconds=59))
                    out.append({"symbol": symbol, "dt": at} | dict(zip(BARS[2:], map(float, r[-6:]), strict=True)))
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("symbol", pa.string()), ("dt", pa.timestamp("us"))] + [(c, pa.float64()) for c in BARS[2:]]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "symbol string, dt timestamp_ntz, " + ", ".join(f"{c} double" for c in BARS[2:]))


def feature_file(spark: SparkSession, path: str, schema: str | None = None, tail_rows: int | None = None, order: str = "dt") -> DataFrame:
    """A feature table: Parquet, or CSV (also gzipped) with the given schema; the last rows in order if `tail_rows`."""
    df = spark.read.csv(path, schema=schema, header=True) if ".csv" in path else spark.read.parquet(path)
    return df.orderBy(F.desc(order)).limit(tail_rows) if tail_rows else df


def time_series(df: DataFrame, minutes: int) -> DataFrame:
    """Means of fields by tumbling windows, as a time-series server would send them; empty windows are left out."""
    return df.groupBy("symbol", F.window("dt", f"{minutes} minutes").alias("w")).agg(*(F.avg(c).alias(c) for c in BARS[2:])).select("symbol", F.col("w.start").cast("timestamp_ntz").alias("dt"), *BARS[2:])


def with_zone(df: DataFrame, from_zone: str, to_zone: str = "UTC") -> DataFrame:
    """Times read in one zone, given in another."""
    return df.withColumn("dt", F.convert_timezone(F.lit(from_zone), F.lit(to_zone), F.col("dt")))


class Feeds:
    """A reader with its options and base path set: feeds.get("name.csv", symbol)."""

    def __init__(self, reader, spark: SparkSession, basepath: str = "", **options):
        self.reader, self.spark, self.basepath, self.options = reader, spark, basepath.rstrip("/"), options

    def get(self, name: str, *args, **more) -> DataFrame:
        return self.reader(self.spark, f"{self.basepath}/{name}" if self.basepath else name, *args, **self.options, **more)
