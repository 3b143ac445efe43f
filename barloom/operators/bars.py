"""Bar pipelines: resampling, replay, gap filling, session filters, bar splitting, calendars and timers.

Frames have the columns of bars: symbol, dt, open, high, low, close, volume, openinterest. Times are without a zone, and
arithmetic on them is done in whole microseconds of the day, so no session setting changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.ordered import in_order

SECOND, DAY = 1_000_000, 86_400_000_000
_UNITS = {"seconds": SECOND, "minutes": 60 * SECOND, "hours": 3600 * SECOND}


def micros_of_day(dt: Column | str = "dt") -> Column:
    return F.timestamp_diff("MICROSECOND", F.date_trunc("day", dt).cast("timestamp_ntz"), F.col(dt) if isinstance(dt, str) else dt)


def day_of(dt: Column | str = "dt") -> Column:
    return F.date_trunc("day", dt).cast("timestamp_ntz")


def clock(text: str) -> int:
    """Microseconds of the day of 'HH:MM[:SS]'."""
    parts = [int(x) for x in text.split(":")] + [0, 0]
    return (parts[0] * 3600 + parts[1] * 60 + parts[2]) * SECOND


def _time(day: Column, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, day)


def bucket(dt: str, timeframe: str, compression: int, right: bool = True, boundary: int = 0) -> Column:
    """The label of a bar's bucket. Below a day buckets are counted from midnight; closed and labelled at the right edge, or at
    the left. `boundary` (in seconds) moves the edges. From days on the start of the calendar period."""
    if timeframe in _UNITS:
        step = _UNITS[timeframe] * compression
        micros = micros_of_day(dt) - boundary * SECOND
        count = F.floor((micros + (step - 1 if right else 0)) / F.lit(step))
        return _time(day_of(dt), (count * step + boundary * SECOND).cast("long"))
    return F.date_trunc({"days": "day", "weeks": "week", "months": "month", "years": "year"}[timeframe], dt).cast("timestamp_ntz")


def _ohlc(grouped, dt: Column) -> DataFrame:
    return grouped.agg(dt.alias("dt"), F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume"), F.max_by("openinterest", "dt").alias("openinterest"))


_BARS = ["symbol", "dt", "open", "high", "low", "close", "volume", "openinterest"]


def resample(bars: DataFrame, timeframe: str, compression: int = 1, right: bool = True, session_end: str = "23:59:59", boundary: int = 0) -> DataFrame:
    """Larger bars: first open, highest high, lowest low, last close, summed volume, last open interest.

    ticks: every `compression` rows. seconds, minutes, hours: bar2edge buckets (see `bucket`). days and more: `compression`
    periods that have rows, counted from the first; days are stamped at `session_end`, larger bars with their last row's time.
    The last bucket is returned though it may be incomplete.
    """
    if timeframe == "ticks":
        n = F.row_number().over(Window.partitionBy("symbol").orderBy("dt"))
        return _ohlc(bars.withColumn("_b", F.floor((n - 1) / compression)).groupBy("symbol", "_b"), F.max("dt")).select(*_BARS)
    marked = bars.withColumn("_b", bucket("dt", timeframe, compression, right, boundary))
    if timeframe in _UNITS:
        return _ohlc(marked.groupBy("symbol", "_b"), F.col("_b")).select(*_BARS)
    small = _ohlc(marked.groupBy("symbol", "_b"), F.max("dt"))
    if compression > 1:
        n = F.dense_rank().over(Window.partitionBy("symbol").orderBy("_b"))
        small = _ohlc(small.withColumn("_g", F.floor((n - 1) / compression)).groupBy("symbol", "_g"), F.max("dt"))
    stamp = _time(day_of("dt"), F.lit(clock(session_end))) if timeframe == "days" else F.col("dt")
    return small.withColumn("dt", stamp).select(*_BARS)


def replay(bars: DataFrame, timeframe: str, compression: int = 1) -> DataFrame:
    """The larger bar as it stands after every row: running first, highest, lowest, last and sum inside its bucket."""
    w = Window.partitionBy("symbol", "_b").orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bars.withColumn("_b", bucket("dt", timeframe, compression)).select("symbol", "dt", F.col("_b").alias("bucket"), F.first("open").over(w).alias("open"), F.max("high").over(w).alias("high"), F.min("low").over(w).alias("low"), F.col("close"), F.sum("volume").over(w).alias("volume"), F.col("openinterest"))


def resample_features(bars: DataFrame, minutes: int) -> DataFrame:
    """Left-closed, left-labelled buckets, as data-frame tools cut them."""
    return resample(bars, "minutes", minutes, right=False)


# Gap filling


def _filled(bars: DataFrame, grid: DataFrame, price: float | None, volume: float | None, interest: float | None) -> DataFrame:
    """Rows of the grid (symbol, dt) that bars lacks, between the bars. price: None or 0 the last close, -1 the middle of the last bar, else itself."""
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = grid.join(bars, ["symbol", "dt"], "full")
    before = lambda c: F.last(c, ignorenulls=True).over(w)
    middle = (F.last("high", ignorenulls=True).over(w) + F.last("low", ignorenulls=True).over(w)) / 2
    value = before("close") if not price else middle if price == -1 else F.lit(float(price))
    out = joined.select("symbol", "dt", *(F.col(c).alias(c) for c in _BARS[2:]), value.alias("_v"), F.col("close").isNull().alias("_new"))
    given = {"volume": volume, "openinterest": interest}
    return out.select("symbol", "dt", *(F.coalesce(c, F.when(F.col("_new"), F.col("_v"))).alias(c) for c in _BARS[2:6]), *(F.when(F.col("_new"), F.lit(given[c]).cast("double")).otherwise(F.col(c)).alias(c) for c in _BARS[6:]))


def calendar_days(bars: DataFrame, fill_price: float | None = None, fill_vol: float | None = None, fill_oi: float | None = None, weekdays_only: bool = False) -> DataFrame:
    """Daily bars with the missing days between each symbol's first and last; with `weekdays_only` Monday to Friday."""
    days = bars.groupBy("symbol").agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    grid = days.select("symbol", F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"))).alias("day")).select("symbol", F.col("day").cast("timestamp_ntz").alias("dt"))
    if weekdays_only:
        grid = grid.where(F.weekday("dt") < 5)
    return _filled(bars, grid, fill_price, fill_vol, fill_oi)


def weekdays_filler(bars: DataFrame, fillclose: bool = False) -> DataFrame:
    """Missing Mondays to Fridays, with the last close or without prices."""
    out = calendar_days(bars, weekdays_only=True)
    if fillclose:
        return out
    known = bars.select("symbol", "dt", F.lit(True).alias("_known"))
    prices = [F.when(F.col("_known"), F.col(c)).alias(c) for c in _BARS[2:6]]
    return out.join(known, ["symbol", "dt"], "left").select("symbol", "dt", *prices, "volume", "openinterest")


def session_filler(bars: DataFrame, start: str, end: str, minutes: int, fill_price: float | None = None, fill_vol: float | None = None, fill_oi: float | None = None, skip_first_fill: bool = False) -> DataFrame:
    """Intraday bars at every step of the session on days that have bars; with `skip_first_fill` from a day's first bar on."""
    first = F.min(micros_of_day("dt")) if skip_first_fill else F.lit(clock(start))
    days = bars.where(in_session(start, end)).groupBy("symbol", day_of("dt").alias("day")).agg(first.cast("long").alias("a"))
    steps = F.sequence(F.col("a"), F.lit(clock(end)).cast("long"), F.lit(minutes * 60 * SECOND).cast("long"))
    grid = days.select("symbol", "day", F.explode(steps).alias("m")).select("symbol", _time(F.col("day"), F.col("m")).alias("dt"))
    return _filled(bars, grid, fill_price, fill_vol, fill_oi)


data_filler = session_filler


# Filters


def in_session(start: str, end: str, dt: str = "dt") -> Column:
    return micros_of_day(dt).between(clock(start), clock(end))


def session_filter(bars: DataFrame, start: str, end: str) -> DataFrame:
    return bars.where(in_session(start, end))


def date_range(bars: DataFrame, fromdate: str | None = None, todate: str | None = None) -> DataFrame:
    """Bars from `fromdate` to `todate`, both included; the bounds are pushed down to the scan."""
    if fromdate:
        bars = bars.where(F.col("dt") >= F.lit(fromdate).cast("timestamp_ntz"))
    return bars.where(F.col("dt") <= F.lit(todate).cast("timestamp_ntz")) if todate else bars


def data_filter(bars: DataFrame, keep: Column) -> DataFrame:
    return bars.where(keep)


def simple_filter(bars: DataFrame, drop: Column) -> DataFrame:
    return bars.where(~F.coalesce(drop, F.lit(False)))


# Splitting


def _exploded(bars: DataFrame, *rows: dict[str, Column]) -> DataFrame:
    made = F.array(*(F.struct(*((r.get(c, F.col(c))).alias(c) for c in _BARS[1:])) for r in rows))
    return bars.select("symbol", F.explode(made).alias("r")).select("symbol", "r.*")


def day_splitter(bars: DataFrame, closevol: float = 0.5, session_start: str = "00:00:00", session_end: str = "23:59:59") -> DataFrame:
    """A daily bar as two: open, high and low with the mean price at the session's start, then the close at its end."""
    day, mean = day_of("dt"), (F.col("open") + F.col("high") + F.col("low")) / 3
    first = {"dt": _time(day, F.lit(clock(session_start))), "close": mean, "volume": F.col("volume") * (1 - closevol)}
    close = {c: F.col("close") for c in ("open", "high", "low")}
    return _exploded(bars, first, {"dt": _time(day, F.lit(clock(session_end))), "volume": F.col("volume") * closevol, **close})


def open_then_bar(bars: DataFrame, session_end: str = "23:59:59") -> DataFrame:
    """A daily bar as two: a tick of its open without volume, then the whole bar."""
    tick = {c: F.col("open") for c in ("high", "low", "close")} | {"volume": F.lit(0.0), "openinterest": F.lit(0.0)}
    return _exploded(bars, tick, {"dt": _time(day_of("dt"), F.lit(clock(session_end)))})


def day_steps(bars: DataFrame, closevol: float = 0.5) -> DataFrame:
    """A daily bar as its growing states: open part, then the whole with all of its volume."""
    mean = (F.col("open") + F.col("high") + F.col("low")) / 3
    return _exploded(bars, {"close": mean, "volume": F.col("volume") * (1 - closevol)}, {"dt": _time(day_of("dt"), F.lit(clock("23:59:59")))})


def at_session_end(bars: DataFrame, session_end: str = "23:59:59") -> DataFrame:
    return bars.withColumn("dt", _time(day_of("dt"), F.lit(clock(session_end))))


# Sequences of feeds


def chain(feeds: list[DataFrame]) -> DataFrame:
    """The feeds one after the other; a bar is dropped if its time isn't after all that an earlier feed, or an earlier bar, had."""
    from functools import reduce

    all_ = reduce(DataFrame.unionByName, (f.withColumn("_feed", F.lit(k)) for k, f in enumerate(feeds)))
    ends = all_.groupBy("symbol", "_feed").agg(F.max("dt").alias("_end"))
    w = Window.partitionBy("symbol").orderBy("_feed").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_from", F.max("_end").over(w)).drop("_end")
    return all_.join(ends, ["symbol", "_feed"]).where(F.col("_from").isNull() | (F.col("dt") > F.col("_from"))).drop("_feed", "_from")


def roll_over(feeds: list[DataFrame], from_dates: list[str]) -> DataFrame:
    """Futures in turn: feed k+1 takes over on the first bar not before from_dates[k] on which its volume is larger."""
    out = current = feeds[0]
    for feed, date in zip(feeds[1:], from_dates, strict=True):
        both = current.select("symbol", "dt", F.col("volume").alias("v0")).join(feed.select("symbol", "dt", F.col("volume").alias("v1")), ["symbol", "dt"])
        switch = both.where((F.col("dt") >= F.lit(date).cast("timestamp_ntz")) & (F.col("v1") > F.col("v0"))).groupBy("symbol").agg(F.min("dt").alias("_roll"))
        before = out.join(switch, "symbol", "left").where(F.col("_roll").isNull() | (F.col("dt") < F.col("_roll"))).drop("_roll")
        out, current = before.unionByName(feed.join(switch, "symbol").where(F.col("dt") >= F.col("_roll")).drop("_roll")), feed
    return out


# Bricks


def renko(bars: DataFrame, size: float | None = None, autosize: float = 20.0, align: float = 1.0, roundstart: bool = True) -> DataFrame:
    """Bricks: a row for each bar whose close leaves the last brick by `size` (the first open over `autosize` if not given).

    An ordered fold in one pass over sorted partitions; the state of a symbol is the brick's two edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = top = bottom = step = None
        for batch in batches:
            out = {c: [] for c in ("symbol", "dt", "open", "high", "low", "close", "volume", "openinterest")}
            for r in batch.to_pylist():
                if r["symbol"] != last:
                    last, step = r["symbol"], size or (r["open"] // autosize) or 1.0
                    start = round(r["open"] / align) * align if roundstart else r["open"]
                    top, bottom = start + step, start - step
                    continue
                close = r["close"]
                if close >= top or close <= bottom:
                    up = close >= top
                    n = int((close - top) // step) if up else int((bottom - close) // step)
                    edge = top + n * step if up else bottom - n * step
                    opened = edge - step if up else edge + step
                    row = {"open": opened, "close": edge, "high": max(edge, opened), "low": min(edge, opened)} | {c: r[c] for c in ("symbol", "dt", "volume", "openinterest")}
                    for c, v in row.items():
                        out[c].append(v)
                    top, bottom = (edge + step, edge - 2 * step) if up else (edge + 2 * step, edge - step)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("symbol", pa.string()), ("dt", pa.timestamp("us"))] + [(c, pa.float64()) for c in list(out)[2:]]))

    own = bars.select("symbol", "dt", *(F.col(c).cast("double") for c in _BARS[2:]))
    return in_order(own, ["symbol"], "dt").mapInArrow(run, "symbol string, dt timestamp_ntz, open double, high double, low double, close double, volume double, openinterest double")


# Calendars and timers


def trading_calendar(spark, start: str, end: str, holidays: list[str] = (), offdays: tuple[int, ...] = (5, 6), open_: str = "09:00", close: str = "17:30", early: dict[str, str] | None = None) -> DataFrame:
    """day, opens, closes, next_day, last_of_week, last_of_month, last_of_year for every trading day (Monday is 0)."""
    def trading(d):
        off = F.weekday(d).isin(*offdays) if offdays else F.lit(False)
        return ~(off | d.isin(*[F.lit(h).cast("date") for h in holidays])) if holidays else ~off

    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS day")
    days = days.where(trading(F.col("day")))
    day, closes = F.col("day").cast("timestamp_ntz"), F.lit(clock(close))
    for d, at in (early or {}).items():
        closes = F.when(F.col("day") == F.lit(d).cast("date"), F.lit(clock(at))).otherwise(closes)
    reach = 8 + len(holidays)  # no closure is longer than a week and all holidays
    following = F.get(F.filter(F.sequence(F.date_add("day", 1), F.date_add("day", reach)), lambda d: trading(d) & (d <= F.lit(end).cast("date"))), F.lit(0))
    out = days.select("day", _time(day, F.lit(clock(open_))).alias("opens"), _time(day, closes).alias("closes"), following.alias("next_day"))
    last = lambda unit: F.coalesce(F.date_trunc(unit, "day") != F.date_trunc(unit, "next_day"), F.lit(True))
    return out.select("*", last("week").alias("last_of_week"), last("month").alias("last_of_month"), last("year").alias("last_of_year"))


def timer(bars: DataFrame, when: str, offset_minutes: int = 0, repeat_minutes: int = 0, weekdays: tuple[int, ...] = (), monthdays: tuple[int, ...] = (), monthcarry: bool = True) -> DataFrame:
    """Once a day, the first bar not before `when` (and then the first bar of every repeat): symbol, dt, due.

    weekdays: only these (Monday is 0). monthdays: only these; one that has no bars carries over to the next day that has.
    """
    begin = clock(when) + offset_minutes * 60 * SECOND
    late = F.floor((micros_of_day("dt") - begin) / (repeat_minutes * 60 * SECOND)) if repeat_minutes else F.lit(0)
    rows = bars.where(micros_of_day("dt") >= begin).select("symbol", "dt", day_of("dt").alias("day"), late.cast("long").alias("turn"))
    fired = rows.groupBy("symbol", "day", "turn").agg(F.min("dt").alias("dt"))
    fired = fired.withColumn("due", _time(F.col("day"), (F.lit(begin) + F.col("turn") * (repeat_minutes * 60 * SECOND)).cast("long")))
    if weekdays:
        fired = fired.where(F.weekday("day").isin(*weekdays))
    if monthdays:
        wanted = F.dayofmonth("day").isin(*monthdays)
        if monthcarry:
            w = Window.partitionBy("symbol").orderBy("day")
            gone = fired.select("symbol", "day").distinct().withColumn("before", F.lag("day").over(w))
            missed = F.exists(F.transform(F.sequence(F.coalesce(F.date_add("before", 1), F.col("day").cast("date")), F.col("day").cast("date")), F.dayofmonth), lambda d: d.isin(*monthdays))
            fired = fired.join(gone.where(missed).select("symbol", "day"), ["symbol", "day"], "left_semi")
        else:
            fired = fired.where(wanted)
    return fired.select("symbol", "dt", "due")
