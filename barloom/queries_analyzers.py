"""Queries over analyzers: the orders' bars stand for equity curves, single orders for trades and executions."""

from __future__ import annotations

from barloom.operators import analyzers as A
from barloom.plans.sql import duck_sql, spark_sql
from barloom.sources.views import HOURLY_SQL, ORDERS_SQL, bars_hourly, bars_orders, read_table

_EQUITY = "SELECT symbol, dt, close * CAST(0.4 AS DOUBLE) + 1000 AS cash, close + 1000 AS value FROM @bars"
_TRADES = "SELECT o_orderpriority AS symbol, o_orderkey AS ref, o_custkey % 2 = 0 AS long, o_orderdate AS dtopen, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS dtclose, o_custkey % 30 AS barlen, o_totalprice - 150000 AS pnl, o_totalprice - 150250 AS pnlcomm FROM @orders"
_EXECUTIONS = "SELECT l_returnflag AS symbol, CAST(l_shipdate AS @ts) AS dt, CASE WHEN l_linestatus = 'F' THEN l_quantity * 7 ELSE -l_quantity * 7 - 7000 END AS size, l_extendedprice AS price FROM @lineitem"


def analyzer_queries() -> dict:
    on_equity = {
        "time_return_month": A.TIME_RETURN("month"), "time_return_day": A.TIME_RETURN("day"), "time_return_week": A.TIME_RETURN("week"), "annual_return": A.ANNUAL_RETURN, "log_returns_rolling": A.LOG_RETURNS(5), "log_returns_observer": A.LOG_RETURNS(1),
        "returns_day": A.RETURNS("day"), "returns_month": A.RETURNS("month"), "sharpe_ratio": A.SHARPE(), "sharpe_ratio_a": A.SHARPE("month", annualize=True, sample=True), "sharpe_ratio_up": A.SHARPE("year", convert=False),
        "drawdown": A.DRAWDOWN, "drawdown_observer": A.DRAWDOWN_OBSERVER, "drawdown_length": A.DRAWDOWN_LENGTH, "time_drawdown": A.TIME_DRAWDOWN("month"), "calmar": A.CALMAR(), "gross_leverage": A.LEVERAGE, "period_stats": A.PERIOD_STATS(),
        "vwr": A.VWR(), "broker_observer": A.BROKER, "fund_observer": A.FUND, "time_return_observer": A.TIME_RETURN_OBSERVER("month"),
    }
    out = {}
    equity_sql = duck_sql(_EQUITY, bars=ORDERS_SQL)
    for name, template in on_equity.items():
        out[f"an_{name}"] = (lambda s, d, t=template: A.analyze(t, equity=spark_sql(_EQUITY, bars=bars_orders(s, d))), duck_sql(template, equity=equity_sql))
    trades_sql = duck_sql(_TRADES, orders="SELECT * FROM orders")
    for name, template in {"sqn": A.SQN, "trade_analyzer": A.TRADE_ANALYZER, "trade_streaks": A.STREAKS, "trades_observer": A.TRADES}.items():
        out[f"an_{name}"] = (lambda s, d, t=template: A.analyze(t, trades=spark_sql(_TRADES, orders=read_table(s, d, "orders"))), duck_sql(template, trades=trades_sql))
    executions_sql = duck_sql(_EXECUTIONS, lineitem="SELECT * FROM lineitem")
    for name, template in {"transactions": A.TRANSACTIONS, "buy_sell_observer": A.BUY_SELL}.items():
        out[f"an_{name}"] = (lambda s, d, t=template: A.analyze(t, executions=spark_sql(_EXECUTIONS, lineitem=read_table(s, d, "lineitem"))), duck_sql(template, executions=executions_sql))
    other = "SELECT symbol, dt, open AS value FROM @bars"
    out["an_benchmark"] = (
        lambda s, d: A.analyze(A.BENCHMARK("month"), equity=spark_sql(_EQUITY, bars=bars_orders(s, d)), benchmark=spark_sql(other, bars=bars_orders(s, d))),
        duck_sql(A.BENCHMARK("month"), equity=equity_sql, benchmark=duck_sql(other, bars=ORDERS_SQL)),
    )
    names = ["click", "view"]

    def positions(s, d):
        from pyspark.sql import functions as F

        p = bars_hourly(s, d).where(F.col("symbol").isin(names)).select(F.lit(1).alias("run"), "symbol", "dt", (F.col("close") * 10).alias("value"))
        return A.positions_value(p, names).select("run", "dt", *(F.round(n, 6).alias(n) for n in names))

    columns = ", ".join(f"round(sum(CASE WHEN symbol = '{n}' THEN close * 10 END), 6) AS \"{n}\"" for n in names)
    out["an_positions_value"] = (positions, f"SELECT 1 AS run, dt, {columns} FROM ({HOURLY_SQL}) WHERE symbol IN ('click', 'view') GROUP BY dt")
    return out
