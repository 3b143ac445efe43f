"""Queries over bar pipelines and alignment, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalar import all_of, any_of, choose_by_order, div_by_zero, div_zero_by_zero, if_else, max_of, min_of, reduce_of, sign_of_difference, sum_of
from barloom.operators import align, bars
from barloom.operators.indicators import CLOSE, HIGH, LOW, OPEN, VOLUME
from barloom.plans.lines import lag, lead, over, row_number
from barloom.queries_indicators import line_query
from barloom.sources.views import HOURLY_SQL, LINES_SQL, ORDERS_SQL, TICKS_SQL, bars_hourly, bars_lines, bars_orders, ticks

_B = "symbol, dt, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, round(openinterest, 6) AS openinterest"
_NAMES = ["open", "high", "low", "close", "volume", "openinterest"]


def tidy(df: DataFrame) -> DataFrame:
    return df.select("symbol", "dt", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in _NAMES))


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as bars of one price, in the order of time and event."""
    t = ticks(spark, sf_dir)
    return t.select("symbol", F.col("ts").alias("dt"), *(F.col("price").alias(c) for c in _NAMES[:4]), "volume", F.lit(0.0).alias("openinterest"))


_TB = f"SELECT symbol, ts AS dt, price AS open, price AS high, price AS low, price AS close, volume, 0::DOUBLE AS openinterest FROM ({TICKS_SQL})"


def _agg(source: str, group: str, label: str) -> str:
    return f"SELECT {label} AS dt, symbol, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low, arg_max(close, dt) AS close, sum(volume) AS volume, arg_max(openinterest, dt) AS openinterest FROM ({source}) GROUP BY symbol, {group}"


_US = "(epoch_us(dt) - epoch_us(date_trunc('day', dt)))"
_DAY = "CAST(date_trunc('day', dt) AS TIMESTAMP)"


def _edge(step: int) -> str:
    return f"({_DAY} + to_microseconds((({_US} + {step - 1}) // {step}) * {step}))"


def _select(sql: str) -> str:
    return f"SELECT {_B} FROM ({sql})"


def _resample(timeframe: str, compression: int, source=tick_bars):
    return lambda spark, d: tidy(bars.resample(source(spark, d), timeframe, compression))


def _periods(source: str, unit: str, compression: int, label: str) -> str:
    small = _agg(source, f"date_trunc('{unit}', dt)", "max(dt)")
    if compression > 1:
        small = _agg(f"SELECT *, (dense_rank() OVER (PARTITION BY symbol ORDER BY date_trunc('{unit}', dt)) - 1) // {compression} AS g FROM ({small})", "g", "max(dt)")
    return _select(f"SELECT * REPLACE ({label} AS dt) FROM ({small})")


_END = "CAST(date_trunc('day', dt) AS TIMESTAMP) + to_microseconds(86399000000)"


def _fill_sql(grid: str, source: str, value: str = "last_value(close IGNORE NULLS) OVER w") -> str:
    return (
        f"WITH b AS ({source}), g AS ({grid}), j AS (SELECT coalesce(g.symbol, b.symbol) AS symbol, coalesce(g.dt, b.dt) AS dt, open, high, low, close, volume, openinterest FROM g FULL JOIN b ON g.symbol = b.symbol AND g.dt = b.dt), "
        f"f AS (SELECT *, {value} AS v FROM j WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)) "
        f"SELECT symbol, dt, round(coalesce(open, v), 6) AS open, round(coalesce(high, v), 6) AS high, round(coalesce(low, v), 6) AS low, round(coalesce(close, v), 6) AS close, round(volume, 6) AS volume, round(openinterest, 6) AS openinterest FROM f"
    )


_RENKO_SQL = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn FROM ({HOURLY_SQL})),
r AS (SELECT symbol, 1::BIGINT AS rn, step, round_even(open, 0) + step AS top, round_even(open, 0) - step AS bottom, FALSE AS made, 0::DOUBLE AS edge, FALSE AS up FROM (SELECT *, CASE WHEN floor(open / 20) > 0 THEN floor(open / 20) ELSE 1::DOUBLE END AS step FROM b WHERE rn = 1)
UNION ALL SELECT symbol, rn, step, CASE WHEN NOT hit THEN top WHEN up THEN edge + step ELSE edge + 2 * step END, CASE WHEN NOT hit THEN bottom WHEN up THEN edge - 2 * step ELSE edge - step END, hit, edge, up
FROM (SELECT r.symbol, b.rn, r.step, r.top, r.bottom, b.close >= r.top OR b.close <= r.bottom AS hit, b.close >= r.top AS up, CASE WHEN b.close >= r.top THEN r.top + floor((b.close - r.top) / r.step) * r.step ELSE r.bottom - floor((r.bottom - b.close) / r.step) * r.step END AS edge FROM r JOIN b ON b.symbol = r.symbol AND b.rn = r.rn + 1))
SELECT b.symbol, b.dt, round(CASE WHEN up THEN edge - step ELSE edge + step END, 6) AS open, round(CASE WHEN up THEN edge ELSE edge + step END, 6) AS high, round(CASE WHEN up THEN edge - step ELSE edge END, 6) AS low, round(edge, 6) AS close, round(volume, 6) AS volume, round(openinterest, 6) AS openinterest FROM r JOIN b USING (symbol, rn) WHERE made"""


def _calendar_grid(where: str = "TRUE") -> str:
    return f"SELECT symbol, dt FROM (SELECT symbol, CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS TIMESTAMP) AS dt FROM b GROUP BY symbol) WHERE {where}"


_SESSION_GRID = "SELECT symbol, day + to_microseconds(m) AS dt FROM (SELECT symbol, day, unnest(generate_series(32400000000, 63000000000, 3600000000)) AS m FROM (SELECT DISTINCT symbol, CAST(date_trunc('day', dt) AS TIMESTAMP) AS day FROM b WHERE epoch_us(dt) - epoch_us(date_trunc('day', dt)) BETWEEN 32400000000 AND 63000000000))"
_MEAN = "(open + high + low) / 3"


def two_halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The orders' bars as two overlapping feeds."""
    b = bars_orders(spark, sf_dir)
    return [b.where("dt < timestamp_ntz'1998-07-01'"), b.where("dt >= timestamp_ntz'1998-01-01'")]


def q_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(bars.chain(two_halves(spark, sf_dir)))


def q_roll_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_halves(spark, sf_dir)
    return tidy(bars.roll_over([a, b.withColumn("volume", F.col("volume") * 1.0 + (F.dayofmonth("dt") % 3) - 1)], ["1998-02-01"]))


_ROLL = f"""WITH o AS ({ORDERS_SQL}), a AS (SELECT * FROM o WHERE dt < TIMESTAMP '1998-07-01'), b AS (SELECT * REPLACE (volume + (extract(day FROM dt) % 3) - 1 AS volume) FROM o WHERE dt >= TIMESTAMP '1998-01-01'),
r AS (SELECT a.symbol, min(a.dt) AS roll FROM a JOIN b ON a.symbol = b.symbol AND a.dt = b.dt WHERE a.dt >= TIMESTAMP '1998-02-01' AND b.volume > a.volume GROUP BY a.symbol)
SELECT {_B} FROM (SELECT a.* FROM a LEFT JOIN r USING (symbol) WHERE roll IS NULL OR dt < roll UNION ALL SELECT b.* FROM b JOIN r USING (symbol) WHERE dt >= roll)"""


def q_merge_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_orders(spark, sf_dir)
    return align.merge_symbols(b, F.lit(1)).select("dt", "symbol", F.round("close", 6).alias("close"))


def q_merge_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_orders(spark, sf_dir)
    feeds = {"urgent": b.where("symbol = '1-URGENT'"), "low": b.where("symbol = '5-LOW'")}
    return align.merge_feeds(feeds).select("dt", F.round("urgent", 6).alias("urgent"), F.round("low", 6).alias("low"))


def q_legacy_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_orders(spark, sf_dir)
    left, right = b.where("symbol = '1-URGENT'").select(F.lit(1).alias("k"), "dt", "close"), b.where("symbol = '5-LOW'").select(F.lit(1).alias("k"), "dt", F.col("close").alias("other"))
    return align.as_of(left, right, ["k"]).select("dt", F.round("close", 6).alias("close"), F.round("other", 6).alias("other"))


def q_couple(spark: SparkSession, sf_dir: str) -> DataFrame:
    fast = bars_orders(spark, sf_dir)
    slow = bars.resample(fast, "weeks").select("symbol", "dt", F.col("close").alias("week_close"), F.col("high").alias("week_high"))
    return align.couple(fast.select("symbol", "dt", "close"), slow, ["week_close", "week_high"]).select("symbol", "dt", *(F.round(c, 6).alias(c) for c in ("close", "week_close", "week_high")))


_WEEK = _agg(ORDERS_SQL, "date_trunc('week', dt)", "max(dt)")


def q_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.timer(bars_hourly(spark, sf_dir), "09:00", repeat_minutes=240, weekdays=(0, 2, 4))


def q_timer_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.timer(bars_orders(spark, sf_dir), "00:00", monthdays=(1, 15))


def q_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.trading_calendar(spark, "2024-01-01", "2024-12-31", holidays=["2024-01-01", "2024-12-25"], early={"2024-12-24": "13:00"}).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("day", "next_day")})


_CALENDAR = """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
t AS (SELECT day, lead(day) OVER (ORDER BY day) AS n FROM d WHERE isodow(day) < 6 AND day NOT IN (DATE '2024-01-01', DATE '2024-12-25'))
SELECT day::TIMESTAMP AS day, day::TIMESTAMP + to_microseconds(32400000000) AS opens, day::TIMESTAMP + to_microseconds(CASE WHEN day = DATE '2024-12-24' THEN 46800000000 ELSE 63000000000 END) AS closes, n::TIMESTAMP AS next_day,
coalesce(date_trunc('week', day) <> date_trunc('week', n), TRUE) AS last_of_week, coalesce(date_trunc('month', day) <> date_trunc('month', n), TRUE) AS last_of_month, coalesce(date_trunc('year', day) <> date_trunc('year', n), TRUE) AS last_of_year FROM t"""


def q_relative_volume_by_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.plans.lines import with_lines

    b = bars_hourly(spark, sf_dir).withColumn("clock", F.hour("dt"))
    out = with_lines(b, {"rvbb": VOLUME / lag(VOLUME, 1)}, key="symbol, clock")
    return out.select("symbol", "dt", F.round("rvbb", 6).alias("rvbb"))


_SCALAR = {
    "added": OPEN + CLOSE, "reduced": HIGH - LOW, "product": HIGH * 2, "ratio": CLOSE / OPEN, "whole": CLOSE // 1000, "remainder": CLOSE % 1000, "power": (CLOSE / 1000) ** 2, "reverse": 1 / CLOSE, "raised": 2 ** (CLOSE / 100000),
    "below": CLOSE < OPEN, "atmost": CLOSE <= OPEN, "above": CLOSE > OPEN, "atleast": CLOSE >= OPEN, "same": CLOSE == OPEN, "other": CLOSE != OPEN, "size": abs(OPEN - CLOSE), "minus": -CLOSE,
    "ago3": CLOSE(-3), "ahead2": CLOSE(2),
}
_GUARDED = {
    "dbz": div_by_zero(CLOSE - OPEN, HIGH - LOW, 7.0), "dzbz": div_zero_by_zero(CLOSE - OPEN, HIGH - LOW, 5.0, 1.0), "cmp": sign_of_difference(CLOSE, OPEN), "cmpex": choose_by_order(CLOSE, OPEN, LOW, CLOSE, HIGH), "iff": if_else(CLOSE > OPEN, HIGH, LOW),
    "joint": all_of(CLOSE > OPEN, VOLUME > 1), "either": any_of(CLOSE > OPEN, VOLUME > 1), "most": max_of(OPEN, CLOSE, lag(CLOSE, 1)), "least_": min_of(OPEN, CLOSE, lag(CLOSE, 1)), "total": sum_of(OPEN, HIGH, LOW), "folded": reduce_of(lambda a, b: a * 0.5 + b, OPEN, HIGH, LOW),
}


def bar_queries() -> dict:
    minute = 60_000_000
    out = {
        "resample_ticks": (_resample("ticks", 25), _select(_agg(f"SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1) // 25 AS g FROM ({_TB})", "g", "max(dt)"))),
        "resample_seconds": (_resample("seconds", 900), _select(_agg(_TB, _edge(900_000_000), _edge(900_000_000)))),
        "resample_minutes": (_resample("minutes", 90), _select(_agg(_TB, _edge(90 * minute), _edge(90 * minute)))),
        "resample_left": (lambda s, d: tidy(bars.resample_features(tick_bars(s, d), 60)), _select(_agg(_TB, "date_trunc('hour', dt)", "CAST(date_trunc('hour', dt) AS TIMESTAMP)"))),
        "resample_daily": (_resample("days", 1), _periods(_TB, "day", 1, _END)),
        "resample_days_3": (_resample("days", 3), _periods(_TB, "day", 3, _END)),
        "resample_weekly": (_resample("weeks", 1, bars_orders), _periods(ORDERS_SQL, "week", 1, "dt")),
        "resample_monthly": (_resample("months", 1, bars_lines), _periods(LINES_SQL, "month", 1, "dt")),
        "resample_quarters": (_resample("months", 3, bars_orders), _periods(ORDERS_SQL, "month", 3, "dt")),
        "resample_yearly": (_resample("years", 1, bars_orders), _periods(ORDERS_SQL, "year", 1, "dt")),
        "calendar_days": (lambda s, d: tidy(bars.calendar_days(bars_orders(s, d), fill_vol=0.0)), _fill_sql(_calendar_grid(), ORDERS_SQL).replace("round(volume, 6)", "round(CASE WHEN close IS NULL THEN 0 ELSE volume END, 6)")),
        "calendar_days_middle": (lambda s, d: tidy(bars.calendar_days(bars_orders(s, d), fill_price=-1)), _fill_sql(_calendar_grid(), ORDERS_SQL, "(last_value(high IGNORE NULLS) OVER w + last_value(low IGNORE NULLS) OVER w) / 2")),
        "weekdays_filler": (lambda s, d: tidy(bars.weekdays_filler(bars_orders(s, d), True)), _fill_sql(_calendar_grid("isodow(dt) < 6"), ORDERS_SQL)),
        "session_filler": (lambda s, d: tidy(bars.session_filler(bars_hourly(s, d), "09:00", "17:30", 60)), _fill_sql(_SESSION_GRID, HOURLY_SQL)),
        "session_filter": (lambda s, d: tidy(bars.session_filter(bars_hourly(s, d), "09:00", "17:00")), f"SELECT {_B} FROM ({HOURLY_SQL}) WHERE {_US} BETWEEN 32400000000 AND 61200000000"),
        "date_range": (lambda s, d: tidy(bars.date_range(bars_orders(s, d), "1997-01-01", "1997-12-31")), f"SELECT {_B} FROM ({ORDERS_SQL}) WHERE dt BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'"),
        "data_filter": (lambda s, d: tidy(bars.data_filter(bars_orders(s, d), F.col("close") > F.col("open"))), f"SELECT {_B} FROM ({ORDERS_SQL}) WHERE close > open"),
        "simple_filter": (lambda s, d: tidy(bars.simple_filter(bars_orders(s, d), F.col("volume") < 2)), f"SELECT {_B} FROM ({ORDERS_SQL}) WHERE volume >= 2"),
        "day_splitter": (lambda s, d: tidy(bars.day_splitter(bars_orders(s, d))), f"SELECT {_B} FROM (SELECT symbol, dt, open, high, low, {_MEAN} AS close, volume * 0.5::DOUBLE AS volume, openinterest FROM ({ORDERS_SQL}) UNION ALL SELECT symbol, {_END}, close, close, close, close, volume * 0.5::DOUBLE, openinterest FROM ({ORDERS_SQL}))"),
        "bar_replayer_open": (lambda s, d: tidy(bars.open_then_bar(bars_orders(s, d))), f"SELECT {_B} FROM (SELECT symbol, dt, open, open AS high, open AS low, open AS close, 0::DOUBLE AS volume, 0::DOUBLE AS openinterest FROM ({ORDERS_SQL}) UNION ALL SELECT symbol, {_END}, open, high, low, close, volume, openinterest FROM ({ORDERS_SQL}))"),
        "day_steps": (lambda s, d: tidy(bars.day_steps(bars_orders(s, d))), f"SELECT {_B} FROM (SELECT symbol, dt, open, high, low, {_MEAN} AS close, volume * 0.5::DOUBLE AS volume, openinterest FROM ({ORDERS_SQL}) UNION ALL SELECT symbol, {_END}, open, high, low, close, volume, openinterest FROM ({ORDERS_SQL}))"),
        "session_end_filler": (lambda s, d: tidy(bars.at_session_end(bars_orders(s, d))), f"SELECT {_B} FROM (SELECT * REPLACE ({_END} AS dt) FROM ({ORDERS_SQL}))"),
        "renko": (lambda s, d: tidy(bars.renko(bars_hourly(s, d))), _RENKO_SQL),
        "chainer": (q_chain, f"SELECT {_B} FROM ({ORDERS_SQL})"),
        "roll_over": (q_roll_over, _ROLL),
        "merge_symbols": (q_merge_symbols, f"WITH b AS ({ORDERS_SQL}), g AS (SELECT dt, symbol FROM (SELECT DISTINCT dt FROM b), (SELECT DISTINCT symbol FROM b)) SELECT g.dt, g.symbol, round(b.close, 6) AS close FROM g ASOF LEFT JOIN b ON g.symbol = b.symbol AND g.dt >= b.dt"),
        "merge_feeds": (q_merge_feeds, f"WITH b AS ({ORDERS_SQL}), t AS (SELECT DISTINCT dt FROM b WHERE symbol IN ('1-URGENT', '5-LOW')), u AS (SELECT * FROM b WHERE symbol = '1-URGENT'), l AS (SELECT * FROM b WHERE symbol = '5-LOW') SELECT t.dt, round(u.close, 6) AS urgent, round(l.close, 6) AS low FROM t ASOF LEFT JOIN u ON t.dt >= u.dt ASOF LEFT JOIN l ON t.dt >= l.dt"),
        "legacy_sync": (q_legacy_sync, f"WITH b AS ({ORDERS_SQL}), u AS (SELECT * FROM b WHERE symbol = '1-URGENT'), l AS (SELECT * FROM b WHERE symbol = '5-LOW') SELECT u.dt, round(u.close, 6) AS close, round(l.close, 6) AS other FROM u ASOF LEFT JOIN l ON u.dt >= l.dt"),
        "couple_timeframes": (q_couple, f"WITH f AS ({ORDERS_SQL}), s AS ({_WEEK}) SELECT f.symbol, f.dt, round(f.close, 6) AS close, round(s.close, 6) AS week_close, round(s.high, 6) AS week_high FROM f ASOF LEFT JOIN s ON f.symbol = s.symbol AND f.dt > s.dt"),
        "timer": (q_timer, f"SELECT symbol, min(dt) AS dt, day + to_microseconds(32400000000 + turn * 14400000000) AS due FROM (SELECT symbol, dt, {_DAY} AS day, ({_US} - 32400000000) // 14400000000 AS turn FROM ({HOURLY_SQL}) WHERE {_US} >= 32400000000 AND isodow(dt) IN (1, 3, 5)) GROUP BY symbol, day, turn"),
        "timer_monthdays": (q_timer_month, f"WITH b AS (SELECT symbol, dt, coalesce(lag(dt) OVER (PARTITION BY symbol ORDER BY dt) + INTERVAL 1 DAY, dt) AS a FROM ({ORDERS_SQL})) SELECT symbol, dt, dt AS due FROM b WHERE len(list_filter(generate_series(a, dt, INTERVAL 1 DAY), lambda d: extract(day FROM d) IN (1, 15))) > 0"),
        "trading_calendar": (q_calendar, _CALENDAR),
        "relative_volume_by_bar": (q_relative_volume_by_bar, f"SELECT symbol, dt, round(volume / lag(volume) OVER (PARTITION BY symbol, extract(hour FROM dt) ORDER BY dt), 6) AS rvbb FROM ({HOURLY_SQL})"),
        "scalar_lines": line_query("orders", _SCALAR),
        "guarded_lines": line_query("orders", _GUARDED),
        "row_numbers": line_query("orders", {"n": row_number(), "nxt": lead(CLOSE, 1), "spread": over("max({0}) OVER ({w}) - min({0}) OVER ({w})", CLOSE)}),
    }
    for unit, n, source, sql in (("minutes", 90, tick_bars, _TB), ("days", 1, tick_bars, _TB), ("weeks", 1, bars_orders, ORDERS_SQL), ("months", 1, bars_orders, ORDERS_SQL), ("seconds", 900, tick_bars, _TB)):
        edge = _edge(n * minute) if unit == "minutes" else _edge(n * 1_000_000) if unit == "seconds" else f"CAST(date_trunc('{unit[:-1]}', dt) AS TIMESTAMP)"

        def run(spark: SparkSession, sf_dir: str, unit=unit, n=n, source=source) -> DataFrame:
            return bars.replay(source(spark, sf_dir), unit, n).select("symbol", "dt", "bucket", *(F.round(c, 6).alias(c) for c in _NAMES))

        w = "(PARTITION BY symbol, bucket ORDER BY dt ROWS UNBOUNDED PRECEDING)"
        out[f"replay_{unit}"] = (run, f"SELECT symbol, dt, bucket, round(first_value(open) OVER {w}, 6) AS open, round(max(high) OVER {w}, 6) AS high, round(min(low) OVER {w}, 6) AS low, round(close, 6) AS close, round(sum(volume) OVER {w}, 6) AS volume, round(openinterest, 6) AS openinterest FROM (SELECT *, {edge} AS bucket FROM ({sql}))")
    return out
