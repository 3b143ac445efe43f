"""Readers and writers: bars are written into the shared folder in each format and read back, against SQL over the tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.sources import readers as R
from barloom.sources import sinks as S
from barloom.sources.shared import own_folder
from barloom.sources.views import HOURLY_SQL, ORDERS_SQL, bars_hourly, bars_orders

_PRICES = ["open", "high", "low", "close", "volume", "openinterest"]
_END = "CAST(date_trunc('day', dt) AS TIMESTAMP) + to_microseconds(86399000000)"
Reader = Callable[[SparkSession, str, str], DataFrame]


def _shown(df: DataFrame, names: list[str] = _PRICES) -> DataFrame:
    return df.select("symbol", "dt", *(F.round(c, 6).alias(c) for c in names))


def _sql(source: str, dt: str = "dt", names: list[str] = _PRICES, **replaced: str) -> str:
    return f"SELECT symbol, {dt} AS dt, {', '.join(f'round({replaced.get(c, c)}, 6) AS {c}' for c in names)} FROM ({source})"


def _each_symbol(df: DataFrame, columns: list[str | Column], reader: Reader, header: bool) -> DataFrame:
    """Writes one folder of CSV files for each symbol, and reads them one by one: a feed is one file to its reader."""
    spark, folder = df.sparkSession, own_folder(df.sparkSession, "feeds")
    df.select("symbol", *columns).write.partitionBy("symbol").csv(folder, header=header)
    symbols = sorted(r["symbol"] for r in df.select("symbol").distinct().collect())  # one row for each feed
    return reduce(DataFrame.unionByName, (reader(spark, f"{folder}/symbol={s}", s) for s in symbols))


def _text(*patterns: str) -> list[Column]:
    return [F.date_format("dt", p).alias(f"t{k}") for k, p in enumerate(patterns)]


def q_vchart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two kinds in one file: hours of events (I) and days of orders (D)."""
    folder = own_folder(spark, "vchart")
    line = lambda df, kind, clock: df.select("symbol", F.lit(kind).alias("kind"), F.date_format("dt", "yyyyMMdd").alias("day"), clock.alias("clock"), *_PRICES)
    both = line(bars_hourly(spark, sf_dir), "I", F.date_format("dt", "HHmm")).unionByName(line(bars_orders(spark, sf_dir), "D", F.lit("0")))
    both.write.csv(folder)
    return _shown(R.vchart_csv(spark, folder))


def q_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal commas, broken lines and a second, later line for every fifth bar: the later one stays."""
    b = bars_hourly(spark, sf_dir).select("symbol", "dt", *_PRICES[:5])
    comma = [F.regexp_replace(F.col(c).cast("string"), r"\.", ",").alias(c) for c in _PRICES[:5]]
    good = b.select("symbol", *_text("yyyyMMdd", "HHmmss"), *comma, F.lit(1).alias("line"))
    early = b.where(F.hour("dt") % 5 == 0).select("symbol", *_text("yyyyMMdd", "HHmmss"), *(F.lit("1,5").alias(c) for c in _PRICES[:5]), F.lit(0).alias("line"))
    broken = b.where(F.hour("dt") == 3).select("symbol", *_text("yyyyMMdd", "HHmmss"), *(F.lit("x").alias(c) for c in _PRICES[:5]), F.lit(2).alias("line"))
    lines = good.unionByName(early).unionByName(broken).repartition(1).sortWithinPartitions("symbol", "line").drop("line")  # one file, as such feeds are
    return _each_symbol(lines, ["t0", "t1", *_PRICES[:5]], R.minute_csv, True).select("symbol", "dt", *(F.round(c, 6).alias(c) for c in _PRICES))


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resample(bars_orders(spark, sf_dir), "years").select("symbol", "dt", *(F.col(c).cast("double").alias(c) for c in _PRICES))


_YEARLY_SQL = f"SELECT symbol, max(dt) AS dt, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low, arg_max(close, dt) AS close, sum(volume) AS volume, arg_max(openinterest, dt) AS openinterest FROM ({ORDERS_SQL}) GROUP BY symbol, date_trunc('year', dt)"


def q_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pandas frames, one for each symbol: by name with the time as index, by position for every other one."""
    pdf = _yearly(spark, sf_dir).orderBy("symbol", "dt").toPandas()  # a row for each year and symbol
    frames = []
    for k, (symbol, own) in enumerate(pdf.groupby("symbol")):
        if k % 2:
            frames.append(R.frame(spark, own.drop(columns="symbol").reset_index(drop=True), symbol, {c: i for i, c in enumerate(_PRICES, 1)}, datetime=0))
        else:
            frames.append(R.frame(spark, own.drop(columns="symbol").set_index("dt").rename(columns=str.upper), symbol))
    return _shown(reduce(DataFrame.unionByName, frames))


def q_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _yearly(spark, sf_dir).collect()  # a row for each year and symbol
    symbols = sorted({r["symbol"] for r in found})
    return _shown(reduce(DataFrame.unionByName, (R.rows(spark, [tuple(r)[1:] for r in found if r["symbol"] == s], s) for s in symbols)))


def q_binary(intraday: bool):
    view = bars_hourly if intraday else bars_orders

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = S.write_binary(view(spark, sf_dir), own_folder(spark, "store"), intraday).collect()  # a row for each file
        return _shown(reduce(DataFrame.unionByName, (R.binary_bars(spark, r["file"], r["symbol"], intraday) for r in made)))

    return run


_SINGLE = {c: f"CAST(CAST({c} AS FLOAT) AS DOUBLE)" for c in _PRICES[:4]} | {c: f"CAST(trunc({c}) AS DOUBLE)" for c in _PRICES[4:]}


def q_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factory of feeds: the base path and options are set once."""
    folder, df = own_folder(spark, "base"), bars_orders(spark, sf_dir)
    df.select("symbol", F.date_format("dt", "dd.MM.yyyy").alias("day"), *_PRICES).write.partitionBy("symbol").csv(folder, sep=";")
    feeds = R.Feeds(R.generic_csv, spark, folder, dtformat="dd.MM.yyyy", sep=";", header=False)
    symbols = sorted(r["symbol"] for r in df.select("symbol").distinct().collect())  # one row for each feed
    return _shown(reduce(DataFrame.unionByName, (feeds.get(f"symbol={s}", s) for s in symbols)))


def q_features(kind: str):
    """A feature table written and read again; the CSV form is gzipped."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = own_folder(spark, "features") + (".csv.gz" if kind == "csv" else ".parquet")
        df = bars_orders(spark, sf_dir)
        S.write_features(df, path)
        return _shown(R.feature_file(spark, path, "symbol string, dt timestamp_ntz, " + ", ".join(f"{c} double" for c in _PRICES)))

    return run


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON summary beside a feature table."""
    folder = own_folder(spark, "summary")
    S.write_features(bars_orders(spark, sf_dir), f"{folder}/table", f"{folder}/summary")
    text = spark.read.text(f"{folder}/summary")
    return text.select(F.from_json("value", "rows long, first timestamp_ntz, last timestamp_ntz").alias("v")).select("v.*")


def q_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 rows of a feature table."""
    path = own_folder(spark, "tail")
    S.write_features(bars_orders(spark, sf_dir).select("symbol", "dt", "close", F.concat_ws("|", F.date_format("dt", "yyyyMMdd"), "symbol").alias("at")), path)
    return R.feature_file(spark, path, tail_rows=500, order="at").select("symbol", "dt", F.round("close", 6).alias("close"))


def q_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.time_series(bars_hourly(spark, sf_dir), 240))


def q_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed with columns of its own behind those of bars."""
    cols = ["day", *_PRICES, "mid", "wide"]
    df = bars_orders(spark, sf_dir).withColumns({"day": F.date_format("dt", "yyyy-MM-dd"), "mid": (F.col("high") + F.col("low")) / 2, "wide": F.col("high") - F.col("low")})
    read = lambda s, path, symbol: R.generic_csv(s, path, symbol, dtformat="yyyy-MM-dd", extra={"mid": 7, "wide": 8})
    return _shown(_each_symbol(df, cols, read, True), [*_PRICES, "mid", "wide"])


def q_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a counter for each symbol, read back."""
    folder = own_folder(spark, "writer")
    S.write_csv(bars_orders(spark, sf_dir).select("symbol", "dt", "open", "close"), folder, rounding=3)
    out = spark.read.csv(folder, header=True, schema="Id long, symbol string, dt timestamp_ntz, open double, close double")
    return out.select(F.col("Id").alias("id"), "symbol", "dt", F.round("close", 2).alias("close"))


def q_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed written again with another separator, and compressed."""
    folder = own_folder(spark, "rewrite")
    S.write_csv(bars_orders(spark, sf_dir), folder, sep=";", counter=False, compression="gzip")
    out = spark.read.csv(folder, header=True, sep=";", schema="symbol string, dt timestamp_ntz, " + ", ".join(f"{c} double" for c in _PRICES))
    return _shown(out)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_orders(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("volume").cast("long").alias("ticks")).orderBy("symbol")


_COUNTS_SQL = f"SELECT symbol, count(*) AS n, CAST(sum(volume) AS BIGINT) AS ticks FROM ({ORDERS_SQL}) GROUP BY symbol"


def q_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as text in memory, line by line."""
    lines = S.to_text(_counts(spark, sf_dir)).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line long, value string")


def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report, line by line."""
    text = S.report({"counts": {r["symbol"]: {"n": r["n"], "ticks": r["ticks"]} for r in _counts(spark, sf_dir).collect()}, "share": {"half": 0.123456}}, rounding=2)  # a row for each symbol
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line long, value string")


_TEXT_SQL = f"SELECT 0::BIGINT AS line, 'symbol,n,ticks' AS value UNION ALL SELECT row_number() OVER (ORDER BY symbol), symbol || ',' || n || ',' || ticks FROM ({_COUNTS_SQL})"
_REPORT_SQL = f"""WITH c AS (SELECT *, row_number() OVER (ORDER BY symbol) - 1 AS k FROM ({_COUNTS_SQL})), l AS (SELECT 0 AS line, '- counts:' AS value
UNION ALL SELECT 3 * k + 1, '  - ' || symbol || ':' FROM c UNION ALL SELECT 3 * k + 2, '    - n: ' || n FROM c UNION ALL SELECT 3 * k + 3, '    - ticks: ' || ticks FROM c
UNION ALL SELECT 3 * (SELECT count(*) FROM c) + 1, '- share:' UNION ALL SELECT 3 * (SELECT count(*) FROM c) + 2, '  - half: 0.12') SELECT CAST(line AS BIGINT) AS line, value FROM l"""


def _unix(spark: SparkSession, sf_dir: str, floating: bool) -> DataFrame:
    stamp = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("dt")) / 1_000_000
    stamp = (stamp + 0.25).cast("decimal(20,2)").cast("string") if floating else stamp.cast("long").cast("string")
    df = bars_hourly(spark, sf_dir).withColumn("t0", stamp)
    read = lambda s, path, symbol: R.generic_csv(s, path, symbol, dtformat="unixfloat" if floating else "unix")
    return _shown(_each_symbol(df, ["t0", *_PRICES], read, True))


def file_queries() -> dict:
    hour = f"SELECT * FROM ({HOURLY_SQL})"
    no_interest = {"openinterest": "NULL::DOUBLE"}

    def generic(**options) -> Reader:
        return lambda s, path, symbol: R.generic_csv(s, path, symbol, **options)

    def stamped(view: Callable, patterns: list[str], reader: Reader, header: bool, names: list[str] = _PRICES):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _shown(_each_symbol(view(spark, sf_dir), [*_text(*patterns), *names], reader, header))

        return run

    def adjusted(reader: Reader, columns: list[str], header: bool = True):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = bars_orders(spark, sf_dir).withColumns({"day": F.date_format("dt", "yyyy-MM-dd"), "adj": F.col("close") / 2, "div": F.lit(0.0), "split": F.lit(1.0)})
            df = df.withColumns({f"a{c}": (F.col(c) * 2 if c == "volume" else F.col(c) / 2) for c in _PRICES[:5]})
            return _shown(_each_symbol(df, columns, reader, header))

        return run

    halves = {c: f"({c} / 2)" for c in _PRICES[:4]} | {"volume": "volume * 2"}
    yahoo = ["day", "open", "high", "low", "close", "adj", "volume"]
    quandl = ["day", *_PRICES[:5], "div", "split", *(f"a{c}" for c in _PRICES[:5])]
    return {
        "read_bar_csv": (stamped(bars_orders, ["yyyy-MM-dd"], R.bar_csv, True), _sql(ORDERS_SQL, _END)),
        "read_bar_csv_timed": (stamped(bars_hourly, ["yyyy-MM-dd", "HH:mm:ss"], R.bar_csv, True), _sql(hour)),
        "read_generic_csv": (stamped(bars_hourly, ["yyyy-MM-dd HH:mm:ss"], generic(), True), _sql(hour)),
        "read_generic_csv_columns": (stamped(bars_hourly, ["dd/MM/yyyy", "HH:mm"], generic(dtformat="dd/MM/yyyy", tmformat="HH:mm", time=1, open=2, high=3, low=4, close=5, volume=-1, openinterest=-1, nullvalue=0.0), True), _sql(hour, volume="0::DOUBLE", openinterest="0::DOUBLE")),
        "read_generic_csv_unix": (lambda s, d: _unix(s, d, False), _sql(hour)),
        "read_generic_csv_unix_float": (lambda s, d: _unix(s, d, True), _sql(hour, "dt + INTERVAL 250 MILLISECOND")),
        "read_mt4_csv": (stamped(bars_hourly, ["yyyy.MM.dd", "HH:mm"], R.mt4_csv, False, _PRICES[:5]), _sql(hour, **no_interest)),
        "read_sierra_csv": (stamped(bars_hourly, ["yyyy/MM/dd", "HH:mm:ss"], R.sierra_csv, True, _PRICES[:5]), _sql(hour, **no_interest)),
        "read_vchart_csv": (q_vchart, f"{_sql(hour)} UNION ALL {_sql(ORDERS_SQL, _END.replace('86399000000', '86340000000'))}"),
        "read_yahoo_csv": (adjusted(lambda s, p, n: R.yahoo_csv(s, p, n, round_=False), yahoo), _sql(ORDERS_SQL, _END, **halves)),
        "read_yahoo_csv_raw": (adjusted(lambda s, p, n: R.yahoo_csv(s, p, n, adjclose=False, round_=False), yahoo), _sql(ORDERS_SQL, _END)),
        "read_yahoo_legacy_csv": (adjusted(lambda s, p, n: R.yahoo_legacy_csv(s, p, n, adjvolume=False, decimals=6), yahoo), _sql(ORDERS_SQL, _END, **(halves | {"volume": "volume"}))),
        "read_quandl_csv": (adjusted(R.quandl_csv, quandl), _sql(ORDERS_SQL, _END, **halves)),
        "read_quandl_csv_raw": (adjusted(lambda s, p, n: R.quandl_csv(s, p, n, adjclose=False), quandl), _sql(ORDERS_SQL, _END)),
        "read_minute_csv": (q_minute, _sql(hour)),
        "read_pandas": (q_pandas, _sql(_YEARLY_SQL)),
        "read_rows": (q_rows, _sql(_YEARLY_SQL)),
        "read_binary_days": (q_binary(False), _sql(ORDERS_SQL, _END, **_SINGLE)),
        "read_binary_minutes": (q_binary(True), _sql(hour, **_SINGLE)),
        "read_feeds": (q_feeds, _sql(ORDERS_SQL, _END)),
        "read_features_parquet": (q_features("parquet"), _sql(ORDERS_SQL)),
        "read_features_csv": (q_features("csv"), _sql(ORDERS_SQL)),
        "read_features_tail": (q_tail, f"SELECT symbol, dt, round(close, 6) AS close FROM ({ORDERS_SQL}) ORDER BY strftime(dt, '%Y%m%d') || '|' || symbol DESC LIMIT 500"),
        "read_time_series": (q_time_series, f"SELECT symbol, time_bucket(INTERVAL 4 HOUR, dt) AS dt, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _PRICES)} FROM ({HOURLY_SQL}) GROUP BY 1, 2"),
        "read_extra_columns": (q_extra, _sql(ORDERS_SQL, _END, [*_PRICES, "mid", "wide"], mid="((high + low) / 2)", wide="(high - low)")),
        "write_csv_counted": (q_writer, f"SELECT row_number() OVER (PARTITION BY symbol ORDER BY dt) AS id, symbol, dt, round(close, 2) AS close FROM ({ORDERS_SQL})"),
        "write_csv_again": (q_rewrite, _sql(ORDERS_SQL)),
        "write_feature_summary": (q_summary, f"SELECT count(*) AS rows, min(dt) AS first, max(dt) AS last FROM ({ORDERS_SQL})"),
        "write_text": (q_text, _TEXT_SQL),
        "write_report": (q_report, _REPORT_SQL),
    }
