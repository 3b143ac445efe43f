import datetime as dt

from helpers import BARS, walk
from pyspark.sql import functions as F

from barloom.operators import align, bars

T = dt.datetime


def made(spark, rows):
    return spark.createDataFrame([("A", t, float(o), float(h), float(lo), float(c), float(v), 0.0) for t, o, h, lo, c, v in rows], BARS)


def test_buckets_are_closed_at_the_right_edge(spark):
    rows = [(T(2024, 1, 1, 9, 0), 1, 2, 1, 2, 1), (T(2024, 1, 1, 9, 1), 2, 5, 2, 4, 1), (T(2024, 1, 1, 9, 5), 4, 4, 0, 1, 1), (T(2024, 1, 1, 9, 6), 1, 1, 1, 1, 1), (T(2024, 1, 2, 0, 0), 7, 7, 7, 7, 1)]
    got = [tuple(r)[1:] for r in bars.resample(made(spark, rows), "minutes", 5).orderBy("dt").collect()]
    assert got == [(T(2024, 1, 1, 9, 0), 1, 2, 1, 2, 1, 0), (T(2024, 1, 1, 9, 5), 2, 5, 0, 1, 2, 0), (T(2024, 1, 1, 9, 10), 1, 1, 1, 1, 1, 0), (T(2024, 1, 2, 0, 0), 7, 7, 7, 7, 1, 0)]
    assert [r.dt for r in bars.resample_features(made(spark, rows), 5).orderBy("dt").collect()] == [T(2024, 1, 1, 9, 0), T(2024, 1, 1, 9, 5), T(2024, 1, 2, 0, 0)]


def test_replay_grows_into_the_resampled_bar(spark):
    df = spark.createDataFrame(walk(60), BARS)
    last = bars.replay(df, "weeks").groupBy("bucket").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "dt").alias("r")).select("bucket", "r.*")
    whole = bars.resample(df, "weeks").select(F.date_trunc("week", "dt").cast("timestamp_ntz").alias("bucket"), "open", "high", "low", "close", "volume")
    key = lambda r: r[0]
    assert sorted((tuple(r) for r in last.collect()), key=key) == sorted((tuple(r) for r in whole.collect()), key=key)


def test_periods_are_counted_where_there_are_rows(spark):
    rows = [(T(2024, 1, d), d, d, d, d, 1) for d in (1, 2, 5, 6, 7)]
    got = bars.resample(made(spark, rows), "days", 2).orderBy("dt").collect()
    assert [(r.dt, r.open, r.close, r.volume) for r in got] == [(T(2024, 1, 2, 23, 59, 59), 1, 2, 2), (T(2024, 1, 6, 23, 59, 59), 5, 6, 2), (T(2024, 1, 7, 23, 59, 59), 7, 7, 1)]
    assert bars.resample(made(spark, rows), "ticks", 2).count() == 3


def test_fillers(spark):
    rows = [(T(2024, 1, 5), 1, 4, 2, 3, 1), (T(2024, 1, 9), 5, 8, 6, 7, 1)]
    df = made(spark, rows)
    assert [(r.dt.day, r.close) for r in bars.calendar_days(df).orderBy("dt").collect()] == [(5, 3), (6, 3), (7, 3), (8, 3), (9, 7)]
    assert [r.open for r in bars.calendar_days(df, fill_price=-1).orderBy("dt").collect()] == [1, 3, 3, 3, 5]
    assert [r.dt.day for r in bars.weekdays_filler(df).orderBy("dt").collect()] == [5, 8, 9]
    assert [r.close for r in bars.weekdays_filler(df).orderBy("dt").collect()] == [3, None, 7]
    intraday = made(spark, [(T(2024, 1, 5, 9), 1, 1, 1, 1, 1), (T(2024, 1, 5, 11), 2, 2, 2, 2, 1)])
    assert [(r.dt.hour, r.close) for r in bars.session_filler(intraday, "09:00", "12:00", 60).orderBy("dt").collect()] == [(9, 1), (10, 1), (11, 2), (12, 2)]


def test_splitters(spark):
    df = made(spark, [(T(2024, 1, 5), 3, 9, 0, 5, 10)])
    a, b = bars.day_splitter(df).orderBy("dt").collect()
    assert (a.close, a.volume, b.open, b.high, b.volume, b.dt) == (4, 5, 5, 5, 5, T(2024, 1, 5, 23, 59, 59))
    a, b = bars.open_then_bar(df).orderBy("dt").collect()
    assert (a.high, a.volume, b.high, b.volume) == (3, 0, 9, 10)


def test_chain_drops_what_an_earlier_feed_had(spark):
    a, b = made(spark, [(T(2024, 1, d), d, d, d, d, 1) for d in (1, 2, 3)]), made(spark, [(T(2024, 1, d), 10 + d, 10 + d, 10 + d, 10 + d, 1) for d in (2, 3, 4)])
    assert [r.close for r in bars.chain([a, b]).orderBy("dt").collect()] == [1, 2, 3, 14]
    c = made(spark, [(T(2024, 1, d), 20 + d, 20 + d, 20 + d, 20 + d, 5) for d in (2, 3, 4)])
    assert [r.close for r in bars.roll_over([a, c], ["2024-01-03"]).orderBy("dt").collect()] == [1, 2, 23, 24]


def test_as_of(spark):
    left = spark.createDataFrame([("A", T(2024, 1, d), d) for d in (1, 3, 5)], "symbol string, dt timestamp_ntz, n int")
    right = spark.createDataFrame([("A", T(2024, 1, d), d * 10) for d in (2, 3, 4)], "symbol string, dt timestamp_ntz, v int")
    assert [(r.n, r.v) for r in align.as_of(left, right, ["symbol"]).orderBy("n").collect()] == [(1, None), (3, 30), (5, 40)]
    assert [(r.n, r.v) for r in align.as_of(left, right, ["symbol"], inclusive=False).orderBy("n").collect()] == [(1, None), (3, 20), (5, 40)]


def test_renko_bricks_leave_no_gap(spark):
    df = spark.createDataFrame(walk(200) + walk(50, "B", 3), BARS)
    out = [r for r in bars.renko(df, size=2.0).where("symbol = 'A'").orderBy("dt").collect()]
    assert out and all(abs(r.close - r.open) == 2 for r in out)


def test_timers_and_calendars(spark):
    df = made(spark, [(T(2024, 1, 5, h), 1, 1, 1, 1, 1) for h in (8, 9, 10, 14)] + [(T(2024, 1, 8, 11), 1, 1, 1, 1, 1)])
    assert [r.dt for r in bars.timer(df, "09:00").orderBy("dt").collect()] == [T(2024, 1, 5, 9), T(2024, 1, 8, 11)]
    assert [r.dt for r in bars.timer(df, "09:00", repeat_minutes=120).orderBy("dt").collect()] == [T(2024, 1, 5, 9), T(2024, 1, 5, 14), T(2024, 1, 8, 11)]
    assert [r.dt.day for r in bars.timer(df, "00:00", monthdays=(7,)).orderBy("dt").collect()] == [8]
    days = bars.trading_calendar(spark, "2024-01-01", "2024-01-31", holidays=["2024-01-01"]).orderBy("day").collect()
    assert days[0].day == dt.date(2024, 1, 2) and [d.day.day for d in days if d.last_of_week][:1] == [5] and days[-1].last_of_month


def test_empty_tables(spark):
    df = spark.createDataFrame([], BARS)
    for out in (bars.resample(df, "minutes", 5), bars.replay(df, "days"), bars.calendar_days(df), bars.renko(df), bars.chain([df, df])):
        assert out.count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    spark.createDataFrame(walk(50), BARS).write.parquet(path)
    plan = bars.date_range(spark.read.parquet(path), "2024-01-10").select("symbol", "close")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dt" in plan and "ReadSchema: struct<symbol:string,dt:timestamp_ntz,close:double>" in plan
