import datetime as dt
import struct

import pandas as pd
from helpers import BARS, walk

from barloom.sources import readers, sinks
from barloom.streaming import bars as S

T = dt.datetime


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def test_csv_readers(spark, tmp_path):
    p = put(tmp_path, "a.csv", "Date,Open,High,Low,Close,Volume,OI\n2024-01-02,1,3,0.5,2,10,0\n2024-01-03,x,3,0.5,2,10,0\n")
    a, b = readers.bar_csv(spark, p, "A").orderBy("dt").collect()
    assert a.dt == T(2024, 1, 2, 23, 59, 59) and a.close == 2 and b.open is None
    p = put(tmp_path, "b.csv", "2024.01.02,09:30,1,3,0.5,2,10\n")
    assert readers.mt4_csv(spark, p, "A").first().dt == T(2024, 1, 2, 9, 30)
    p = put(tmp_path, "c.csv", "t,o,h,l,c,v\n1704186000,1,3,0.5,2,\n")
    r = readers.generic_csv(spark, p, "A", dtformat="unix", openinterest=-1).first()
    assert r.dt == T(2024, 1, 2, 9) and r.volume is None and r.openinterest is None
    p = put(tmp_path, "d.csv", "AB,I,20240102,930,1,3,0.5,2,10,0\nAB,D,20240103,0,1,3,0.5,2,10,0\n")
    assert [r.dt for r in readers.vchart_csv(spark, p).orderBy("dt").collect()] == [T(2024, 1, 2, 9, 30), T(2024, 1, 3, 23, 59)]


def test_adjusted_closes(spark, tmp_path):
    p = put(tmp_path, "y.csv", "Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-02,10,12,8,10,5,100\n2024-01-03,null,null,null,null,null,null\n")
    r = readers.yahoo_csv(spark, p, "A").collect()
    assert len(r) == 1 and (r[0].open, r[0].high, r[0].close, r[0].volume) == (5, 6, 5, 200)


def test_minutes_keep_the_last_of_repeated_times(spark, tmp_path):
    p = put(tmp_path, "m.csv", '<DTYYYYMMDD>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>\n20240102,093000,1,1,1,1,1\n20240102,093000,2,2,2,2,1\n20240102,093100,"2,5",3,2,bad,1\n')
    assert [(r.dt, r.close) for r in readers.minute_csv(spark, p, "A").collect()] == [(T(2024, 1, 2, 9, 30), 2)]


def test_frames_and_binary_files(spark, tmp_path):
    pdf = pd.DataFrame({"Open": [1.0], "HIGH": [2.0], "low": [0.5], "Close": [1.5]}, index=pd.to_datetime(["2024-01-02"]))
    r = readers.frame(spark, pdf, "A").first()
    assert (r.dt, r.open, r.high, r.volume) == (T(2024, 1, 2), 1, 2, None)
    (tmp_path / "x.bin").write_bytes(struct.pack("<IffffII", 2024 * 500 + 1 * 32 + 2, 1, 3, 0.5, 2, 10, 0))
    assert readers.binary_bars(spark, f"file://{tmp_path}/x.bin", "A").first().dt == T(2024, 1, 2, 23, 59, 59)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(walk(255), BARS)
    sinks.write_csv(df, f"file://{tmp_path}/out", rounding=2)
    back = spark.read.csv(f"file://{tmp_path}/out", header=True)
    assert back.count() == 255 and back.columns[:2] == ["Id", "symbol"]
    sinks.write_features(df, f"file://{tmp_path}/f", f"file://{tmp_path}/s")
    assert spark.read.text(f"file://{tmp_path}/s").first()[0].startswith('{"rows":255')
    assert len(sinks.to_text(df).splitlines()) == 256
    assert sinks.report({"a": {"b": 1.23456}}, rounding=2) == "- a:\n  - b: 1.23"


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [("A", T(2024, 1, 1, 9, 0, s), float(s), 1.0, s) for s in range(1, 50, 7)] + [("A", T(2024, 1, 1, 9, 2), 5.0, 1.0, 99)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume double, event_id int")
    df.write.parquet(f"file://{tmp_path}/ticks")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/ticks")
    folder = f"file://{tmp_path}/bars"
    show = lambda out: [(r.dt.minute, r.open, r.close, r.volume) for r in out.orderBy("dt").collect()]
    assert show(S.run_to_end(S.stream_bars(stream, 1, "0 seconds"), folder)) == [(1, 1, 43, 7)]  # the bar of 9:02 is still open
    late = [("A", T(2024, 1, 1, 9, 0, 30), 7.0, 1.0, 100), ("A", T(2024, 1, 1, 9, 1, 50), 4.0, 1.0, 101), ("A", T(2024, 1, 1, 9, 20), 6.0, 1.0, 102)]
    spark.createDataFrame(late, df.schema).write.mode("append").parquet(f"file://{tmp_path}/ticks")
    assert show(S.run_to_end(S.stream_bars(stream, 1, "0 seconds"), folder)) == [(1, 1, 43, 7), (2, 4, 5, 2)]  # the tick of 9:00:30 came too late, that of 9:01:50 in time
    closes = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/ticks").selectExpr("symbol", "ts AS dt", "price AS close")
    got = [r.ema for r in S.run_to_end(S.stream_ema(closes, 3), f"file://{tmp_path}/ema").orderBy("dt").collect()]
    assert got == [None, None, 8.0, 15.0, 22.0, 14.5, 25.25, 34.125, 19.0625, 12.03125, 9.015625]
