"""Queries against their SQL on small tables, one of each family, and the contract of the entry module."""

import math

import duckdb
import pytest

from barloom.queries import ORACLES, QUERIES

NAMES = [
    "ind_moving_average_simple", "ind_exponential_moving_average", "ind_adaptive_moving_average", "ind_macd_histo", "ind_relative_strength_index", "ind_heikin_ashi", "ind_ichimoku", "ind_percent_rank", "ind_laguerre_rsi",
    "resample_minutes", "resample_weekly", "replay_days", "calendar_days", "couple_timeframes", "merge_symbols", "timer", "guarded_lines", "an_sharpe_ratio", "an_drawdown", "an_vwr", "an_trade_streaks", "an_calmar",
    "feat_dmi", "label_pessimistic", "mine_lift", "mine_rule_search", "pick_cooldown", "sim_cross_trades", "stream_bars",
    "ind_zero_lag_indicator", "ind_parabolic_sar", "renko", "pick_topk_per_day", "mine_walk_forward_whole", "mine_scores", "merge_feeds", "trading_calendar", "sim_sweep", "sim_sizers", "sim_commissions", "sim_fillers", "sim_portfolio", "sim_trade_updates", "read_bar_csv", "read_binary_days", "read_minute_csv", "write_report", "stream_ema",
]


def rows(frame):
    fit = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>") else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(fit, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    import os

    c = duckdb.connect()
    for t in os.listdir(small):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{small}/{t}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, small, name):
    got, want = QUERIES[name](spark, small), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got.select(columns).toPandas()) == rows(want[columns])


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 200


def equals_its_sql_on(spark, folder, name, days, per_day, price, open_price=None):
    """Daily bars of one symbol from `per_day` orders a day, all of them at `price` but the first; `n` is the day's number from 0."""
    c = duckdb.connect()
    c.sql(f"""COPY (SELECT n * {per_day} + k AS o_orderkey, (CASE WHEN k = 0 THEN {open_price or price} ELSE {price} END)::DOUBLE AS o_totalprice, TIMESTAMP '1995-01-01' + to_days(CAST(n AS INTEGER)) AS o_orderdate, '5-LOW' AS o_orderpriority
FROM range({days}) a(n), range({per_day}) b(k)) TO '{folder}/orders.parquet'""")
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    got, want = QUERIES[name](spark, str(folder)), c.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(want)
    assert rows(got.select(columns).toPandas()) == rows(want[columns])


@pytest.mark.parametrize("name", ["sim_trade_ids", "sim_trade_updates"])
def test_trips_that_lose_more_than_the_account_has(spark, tmp_path, name):
    equals_its_sql_on(spark, tmp_path, name, 120, 1, "CASE WHEN n % 10 < 5 THEN 900000 + n ELSE 100000 + n END")


def test_a_sweep_that_loses_more_than_its_accounts_have(spark, tmp_path):
    """Closes cross their averages on every bar; what is bought at 900,000 is sold at 100,000."""
    equals_its_sql_on(spark, tmp_path, "sim_sweep", 90, 2, "CASE WHEN n % 2 = 0 THEN 600000 + n ELSE 300000 + n END", "CASE WHEN n % 2 = 0 THEN 100000 ELSE 900000 END")


def test_fillers_take_from_an_order_whatever_large_bars_let_them(spark, tmp_path):
    """They take 30 times 5,000 and 100,000, at 500,000 each: more than 100,000 in all, and than the account has."""
    equals_its_sql_on(spark, tmp_path, "sim_fillers", 31, 10_000, "500000 - n")
