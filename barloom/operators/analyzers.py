"""Analyzers and observers as aggregates and windows over a run.

equity(symbol, dt, cash, value): one row for each bar of a run; `symbol` names the run. trades(symbol, ref, long, dtopen, dtclose,
barlen, pnl, pnlcomm). executions(symbol, dt, size, price). Every function takes frames and returns a frame; the queries are
written once as SQL (see barloom.plans.sql). Periods: 'day', 'week', 'month', 'year'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.sql import spark_sql

#: Periods in a year.
FACTORS = {"day": 252.0, "week": 52.0, "month": 12.0, "year": 1.0}
_RUN = "OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _ends(period: str, value: str = "value") -> str:
    """The last value of every period, and the one before (the first value of the run to begin with)."""
    return (
        f"SELECT symbol, CAST(date_trunc('{period}', dt) AS @ts) AS period, max_by({value}, dt) AS v, min(dt) AS first_dt FROM @equity GROUP BY symbol, CAST(date_trunc('{period}', dt) AS @ts)"
    )


def _returns(period: str, value: str = "value") -> str:
    return f"SELECT e.symbol, e.period, e.v, e.v / nullif(coalesce(lag(e.v) OVER (PARTITION BY e.symbol ORDER BY e.period), s.v0), 0) - 1 AS ret FROM ({_ends(period, value)}) e JOIN (SELECT symbol, min_by({value}, dt) AS v0 FROM @equity GROUP BY symbol) s ON e.symbol = s.symbol"


def TIME_RETURN(period: str) -> str:  # noqa: N802
    return f"SELECT symbol, period, round(ret, 8) AS ret FROM ({_returns(period)})"


ANNUAL_RETURN = TIME_RETURN("year")


def LOG_RETURNS(n: int) -> str:  # noqa: N802
    return f"SELECT symbol, dt, round(ln(value / lag(value, {n}) OVER (PARTITION BY symbol ORDER BY dt)), 8) AS logret FROM @equity"


def _totals(period: str) -> str:
    return f"SELECT symbol, ln(max_by(v, period) / max(v0)) AS rtot, count(*) AS n FROM (SELECT e.*, s.v0 FROM ({_ends(period)}) e JOIN (SELECT symbol, min_by(value, dt) AS v0 FROM @equity GROUP BY symbol) s ON e.symbol = s.symbol) GROUP BY symbol"


def RETURNS(period: str, tann: float | None = None) -> str:  # noqa: N802
    t = tann or FACTORS[period]
    return f"SELECT symbol, round(rtot, 8) AS rtot, round(rtot / n, 8) AS ravg, round(exp(rtot / n * CAST({t} AS DOUBLE)) - 1, 8) AS rnorm, round(100 * (exp(rtot / n * CAST({t} AS DOUBLE)) - 1), 6) AS rnorm100 FROM ({_totals(period)})"


def SHARPE(period: str = "year", rate: float = 0.01, convert: bool = True, annualize: bool = False, sample: bool = False, factor: float | None = None) -> str:  # noqa: N802
    f = factor or FACTORS[period]
    r = f"CAST({(1 + rate) ** (1 / f) - 1 if convert else rate!r} AS DOUBLE)"
    ret = "ret" if convert else f"(power(1 + ret, CAST({f} AS DOUBLE)) - 1)"
    dev = "stddev_samp" if sample else "stddev_pop"
    scale = f" * sqrt(CAST({f} AS DOUBLE))" if convert and annualize else ""
    return f"SELECT symbol, round(avg({ret} - {r}) / nullif({dev}({ret} - {r}), 0){scale}, 6) AS sharperatio FROM ({_returns(period)}) GROUP BY symbol"


_DRAWN = f"SELECT symbol, dt, value, peak, peak - value AS moneydown, 100 * (peak - value) / peak AS drawdown, sum(CASE WHEN value >= peak THEN 1 ELSE 0 END) {_RUN} AS island FROM (SELECT *, max(value) {_RUN} AS peak FROM @equity)"
_LENGTHS = f"SELECT *, sum(CASE WHEN drawdown > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS len FROM ({_DRAWN})"
DRAWDOWN = f"SELECT symbol, CAST(max_by(len, dt) AS BIGINT) AS len, round(max_by(drawdown, dt), 6) AS drawdown, round(max_by(moneydown, dt), 6) AS moneydown, CAST(max(len) AS BIGINT) AS max_len, round(max(drawdown), 6) AS max_drawdown, round(max(moneydown), 6) AS max_moneydown FROM ({_LENGTHS}) GROUP BY symbol"
DRAWDOWN_OBSERVER = f"SELECT symbol, dt, round(drawdown, 6) AS drawdown, round(max(drawdown) {_RUN}, 6) AS maxdrawdown FROM ({_DRAWN})"
DRAWDOWN_LENGTH = f"SELECT symbol, dt, CAST(len AS BIGINT) AS len, CAST(max(len) {_RUN} AS BIGINT) AS maxlen FROM ({_LENGTHS})"


def _time_drawn(period: str) -> str:
    run = "OVER (PARTITION BY symbol ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    peak = f"SELECT symbol, period, v, max(v) {run} AS peak FROM ({_ends(period)})"
    risen = f"SELECT *, CASE WHEN peak > lag(peak) OVER (PARTITION BY symbol ORDER BY period) OR lag(peak) OVER (PARTITION BY symbol ORDER BY period) IS NULL THEN 1 ELSE 0 END AS up FROM ({peak})"
    dd = f"SELECT *, 100 * (peak - v) / peak AS dd, sum(up) {run} AS island FROM ({risen})"
    return f"SELECT *, sum(CASE WHEN dd > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS len FROM ({dd})"


def TIME_DRAWDOWN(period: str) -> str:  # noqa: N802
    return f"SELECT symbol, round(max(dd), 6) AS maxdrawdown, CAST(max(len) AS BIGINT) AS maxdrawdownperiod FROM ({_time_drawn(period)}) GROUP BY symbol"


def CALMAR(period: str = "month", n: int = 36) -> str:  # noqa: N802
    run = "(PARTITION BY symbol ORDER BY period)"
    inner = f"SELECT symbol, period, v, lag(v, {n - 1}) OVER {run} AS v0, max(dd) OVER (PARTITION BY symbol ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mdd FROM ({_time_drawn(period)})"
    return f"SELECT symbol, period, round(ln(v / v0) / {n} / nullif(mdd, 0), 8) AS calmar FROM ({inner}) WHERE v0 IS NOT NULL"


LEVERAGE = "SELECT symbol, dt, round((value - cash) / nullif(value, 0), 8) AS leverage FROM @equity"


def PERIOD_STATS(period: str = "year", zero_is_positive: bool = False) -> str:  # noqa: N802
    up = ">=" if zero_is_positive else ">"
    return f"SELECT symbol, round(avg(ret), 8) AS average, round(stddev_pop(ret), 8) AS stddev, CAST(sum(CASE WHEN ret {up} 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN ret < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, CAST(sum(CASE WHEN ret = 0 AND '{up}' = '>' THEN 1 ELSE 0 END) AS BIGINT) AS nochange, round(max(ret), 8) AS best, round(min(ret), 8) AS worst FROM ({_returns(period)}) GROUP BY symbol"


def VWR(period: str = "month", tau: float = 0.20, sdev_max: float = 2.0) -> str:  # noqa: N802
    t = FACTORS[period]
    each = f"SELECT r.symbol, r.v / (first_value(p0) OVER (PARTITION BY r.symbol ORDER BY r.period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * exp(a.rtot / a.n * row_number() OVER (PARTITION BY r.symbol ORDER BY r.period))) - 1 AS off, a.rtot, a.n FROM (SELECT *, v / (1 + ret) AS p0 FROM ({_returns(period)})) r JOIN ({_totals(period)}) a ON r.symbol = a.symbol"
    return f"SELECT symbol, round(max(100 * (exp(rtot / n * CAST({t} AS DOUBLE)) - 1)) * (1 - power(stddev_samp(off) / CAST({sdev_max} AS DOUBLE), CAST({tau} AS DOUBLE))), 6) AS vwr FROM ({each}) GROUP BY symbol"


SQN = "SELECT symbol, count(*) AS trades, round(CASE WHEN count(*) > 1 THEN sqrt(CAST(count(*) AS DOUBLE)) * avg(pnlcomm) / nullif(stddev_pop(pnlcomm), 0) ELSE CAST(0 AS DOUBLE) END, 6) AS sqn FROM @trades GROUP BY symbol"
_CLOSED = "SELECT *, CASE WHEN pnlcomm >= 0 THEN 1 ELSE 0 END AS won, CASE WHEN long THEN 1 ELSE 0 END AS is_long FROM @trades WHERE dtclose IS NOT NULL"
#: Counts, sums and lengths in total, by won or lost, by long or short, and by both; null stands for all.
TRADE_ANALYZER = f"SELECT symbol, won, is_long, count(*) AS n, round(sum(pnl), 4) AS pnl_total, round(avg(pnl), 4) AS pnl_average, round(sum(pnlcomm), 4) AS net_total, round(max(pnlcomm), 4) AS net_max, round(min(pnlcomm), 4) AS net_min, CAST(sum(barlen) AS BIGINT) AS len_total, CAST(max(barlen) AS BIGINT) AS len_max, CAST(min(barlen) AS BIGINT) AS len_min FROM ({_CLOSED}) GROUP BY GROUPING SETS ((symbol), (symbol, won), (symbol, is_long), (symbol, won, is_long))"
#: The longest and the last run of won and of lost trades.
STREAKS = f"SELECT symbol, won, max(n) AS longest, max_by(n, last_ref) AS latest FROM (SELECT symbol, won, grp, count(*) AS n, max(ref) AS last_ref FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dtclose, ref) - row_number() OVER (PARTITION BY symbol, won ORDER BY dtclose, ref) AS grp FROM ({_CLOSED})) GROUP BY symbol, won, grp) GROUP BY symbol, won"
TRANSACTIONS = "SELECT symbol, dt, round(sum(size), 6) AS size, round(sum(size * price) / nullif(sum(size), 0), 4) AS price, round(-sum(size * price), 4) AS value FROM @executions GROUP BY symbol, dt"
BUY_SELL = "SELECT symbol, dt, round(avg(CASE WHEN size > 0 THEN price END), 6) AS buy, round(avg(CASE WHEN size < 0 THEN price END), 6) AS sell FROM @executions GROUP BY symbol, dt"
BROKER = "SELECT symbol, dt, round(cash, 6) AS cash, round(value, 6) AS value FROM @equity"
FUND = "SELECT symbol, dt, round(100 * value / v0, 6) AS fundval, round(v0 / 100, 6) AS fundshares FROM (SELECT *, first_value(value) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0 FROM @equity)"
TRADES = "SELECT symbol, dtclose AS dt, round(sum(CASE WHEN pnlcomm >= 0 THEN pnlcomm END), 4) AS pnlplus, round(sum(CASE WHEN pnlcomm < 0 THEN pnlcomm END), 4) AS pnlminus FROM @trades WHERE dtclose IS NOT NULL GROUP BY symbol, dtclose"


def TIME_RETURN_OBSERVER(period: str) -> str:  # noqa: N802
    """The running return of the current period at every bar."""
    before = f"SELECT symbol, period, coalesce(lag(v) OVER (PARTITION BY symbol ORDER BY period), v0) AS base FROM (SELECT e.*, s.v0 FROM ({_ends(period)}) e JOIN (SELECT symbol, min_by(value, dt) AS v0 FROM @equity GROUP BY symbol) s ON e.symbol = s.symbol)"
    return f"SELECT e.symbol, e.dt, round(e.value / nullif(b.base, 0) - 1, 8) AS timereturn FROM @equity e JOIN ({before}) b ON e.symbol = b.symbol AND CAST(date_trunc('{period}', e.dt) AS @ts) = b.period"


def BENCHMARK(period: str) -> str:  # noqa: N802
    """Returns of a run and of another series by period."""
    other = _returns(period).replace("@equity", "@benchmark")
    return f"SELECT a.symbol, a.period, round(a.ret, 8) AS timereturn, round(b.ret, 8) AS benchmark FROM ({_returns(period)}) a JOIN ({other}) b ON a.symbol = b.symbol AND a.period = b.period"


def analyze(template: str, **frames: DataFrame) -> DataFrame:
    """Runs one of the queries above, e.g. analyze(SHARPE("month"), equity=frame)."""
    return spark_sql(template, **frames)


def positions_value(positions: DataFrame, symbols: list[str]) -> DataFrame:
    """positions(run, symbol, dt, value) as one row for each run and time with a column for each symbol."""
    return positions.groupBy("run", "dt").pivot("symbol", symbols).sum("value")


def pyfolio(equity: DataFrame, executions: DataFrame, positions: DataFrame, symbols: list[str]) -> dict[str, DataFrame]:
    """returns, positions, transactions and gross_lev of a run."""
    return {"returns": analyze(TIME_RETURN("day"), equity=equity), "positions": positions_value(positions, symbols), "transactions": analyze(TRANSACTIONS, executions=executions), "gross_lev": analyze(LEVERAGE, equity=equity)}


def order_observer(orders: DataFrame) -> DataFrame:
    """symbol, dt, created, expired for every buying order: the bar on which it was made, its price then, and whether it expired."""
    from barloom.operators.broker import BUY

    return orders.where(F.col("side") == BUY).select("symbol", F.col("created").alias("dt"), F.col("price").alias("created"), (F.col("status") == "Expired").alias("expired"))


def trades_by(trades: DataFrame, column: str, values: list, stem: str) -> DataFrame:
    """symbol, dt and a column for each of `values`: outcomes of the trades closed then whose `column` has the value."""
    mine = lambda v: F.sum(F.when(F.col(column) == v, F.col("pnlcomm"))).alias(f"{stem}_{v}")
    return trades.where("dtclose IS NOT NULL").groupBy("symbol", F.col("dtclose").alias("dt")).agg(*map(mine, values))
