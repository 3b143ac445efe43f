import datetime as dt
import random

import pytest
from helpers import BARS, column, walk
from pyspark.sql import functions as F

from barloom.operators import mining as M
from barloom.operators.trailing import multi_take_profit, pair_trading
from barloom.plans.lines import with_lines


def made(spark, rows):
    return spark.createDataFrame([("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=k), float(c), float(h), float(lo), float(c), 1.0, 0.0) for k, (lo, h, c) in enumerate(rows)], BARS)


def test_rules():
    assert M.parse_rule("a <= 1.5 & b >= -2e3") == [("a", "<=", 1.5), ("b", ">=", -2000.0)]
    assert M.simplify_rule(M.parse_rule("a <= 3 & a <= 2 & a >= 0 & a >= 1")) == [("a", "<=", 2.0), ("a", ">=", 1.0)]
    for bad in ("a < 1", "a <= b", "", "a <= 1; drop"):
        with pytest.raises(ValueError):
            M.parse_rule(bad)


def test_both_in_one_bar_is_a_loss(spark):
    df = made(spark, [(10, 10, 10), (8, 12, 10), (10, 12, 11), (10, 11, 10)])
    out = with_lines(df, M.pessimistic_label(2, 0.1, 0.1))
    assert column(out, "label")[:2] == [-1.0, 1.0] and column(out, "bars")[:2] == [1.0, 1.0]
    first = with_lines(df, M.first_hit_label(2, 0.05, 0.05))
    assert column(first, "label") == [1.0, 0.0, 0.0, 0.0]


def test_bins_and_lift(spark):
    df = spark.createDataFrame([(float(k), int(k >= 8)) for k in range(10)] + [(None, 0)], "x double, y int")
    edges = M.quantile_edges(df, ["x"], 3)["x"]
    assert edges == [0.0, 3.0, 6.0, 9.0]
    got = {r.bin: (r.n, r.event_rate) for r in M.lift_table(df, "y", {"x": M.apply_bins("x", edges)}).collect()}
    assert got == {0: (4, 0.0), 1: (3, 0.0), 2: (3, 2 / 3)}


def test_rule_search_counts_like_a_filter(spark):
    df = spark.createDataFrame([(k % 2, k % 3, k % 5, int(k % 7 == 0)) for k in range(210)], "a int, b int, c int, y int")
    flags = {"a": F.col("a") == 0, "b": F.col("b") == 0, "c": F.col("c") == 0}
    got = {r.rule: (r.n, round(r.rate, 9)) for r in M.rule_search(df, "y", flags).collect()}
    for rule, (n, rate) in got.items():
        rows = df.where(" AND ".join(f"{x} = 0" for x in rule.split(" & "))).collect()
        assert (n, rate) == (len(rows), round(sum(r.y for r in rows) / len(rows), 9))
    rule, rate = M.mine_rule(df, "y", [("a", "<=", 0.0), ("b", "<=", 0.0)], min_hits=5)
    assert rule and rate >= 1 / 7 - 1e-9


def test_greedy_picks(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("A", t0 + dt.timedelta(minutes=m), float(s)) for m, s in ((0, 1), (5, 9), (9, 3), (16, 2), (30, 8))], "symbol string, dt timestamp_ntz, score double")
    assert [r.dt.minute for r in M.greedy_pick(df, ["symbol"], [F.col("dt")], 600).orderBy("dt").collect()] == [0, 16, 30]
    assert sorted(r.score for r in M.greedy_pick(df, ["symbol"], [F.desc("score")], 600, limit=2).collect()) == [8, 9]


def test_takes_stops_and_trails(spark):
    df = made(spark, [(100, 100, 100), (100, 101.5, 101), (101, 102.5, 102), (95, 102, 96), (96, 97, 96)]).withColumn("enter", F.col("dt") == F.lit("2024-01-01").cast("timestamp_ntz"))
    r = multi_take_profit(df, "enter", (0.01, 0.02), (0.5, 0.3), stop=0.01, trail=0.02).first()
    assert (r.take_hits, r.bars_to_take, r.bars) == (2, 1, 3) and abs(r.pnl - (0.5 * 0.01 + 0.3 * 0.02 + 0.2 * (102.5 * 0.98 / 100 - 1))) < 1e-12
    r = multi_take_profit(df, "enter", (0.5,), (1.0,), stop=0.01).first()
    assert (r.outcome, r.take_hits) == (-1, 0) and abs(r.pnl + 0.01) < 1e-12
    r = multi_take_profit(df, "enter", (0.5,), (1.0,), stop=0.5, hold=2).first()
    assert r.bars == 2 and abs(r.pnl - 0.02) < 1e-12


def test_pairs(spark):
    rows = [(1, dt.datetime(2024, 1, 1 + k), 10.0 + k, 10.0, z) for k, z in enumerate([None, 0.0, 3.0, 2.0, 0.1, -3.0])]
    out = pair_trading(spark.createDataFrame(rows, "pair int, dt timestamp_ntz, y double, x double, zscore double"), cash=1000.0).orderBy("dt").collect()
    assert [r.status for r in out] == [0, 0, -1, -1, 0, 1] and out[2].size_y == -41 and out[3].value == 1000 - 41


def test_names_and_spaces():
    assert M.feature_meta("delta_5_ema20_tf60") == {"family": "ema", "scale": 20, "tf": 60, "delta": 5}
    assert M.may_extend(["ema20_tf60"], "rsi14_tf60") and not M.may_extend(["ema20_tf60"], "ema30_tf60") and M.may_extend(["ema20_tf60"], "ema100_tf60")
    assert M.candidate_features(["ema20", "delta_3_ema20", "close"], ("ema",)) == ["ema20", "delta_3_ema20"]
    got = M.sample_spec({"a": "1-3", "b": ["x", "y"], "c": 7, "d": "0.5-0.6"}, 20, 1)
    assert all(1 <= g["a"] <= 3 and g["b"] in "xy" and g["c"] == 7 and 0.5 <= g["d"] <= 0.6 for g in got) and got == M.sample_spec({"a": "1-3", "b": ["x", "y"], "c": 7, "d": "0.5-0.6"}, 20, 1)
    assert M.loss_risk(0.5, -0.1, 0.2) == {"losses_to_drawdown": 3, "streak_probability": 0.125}


def test_features_are_finite_or_null(spark):
    df = spark.createDataFrame(walk(80), BARS)
    out = with_lines(df, M.price_action() | M.timeframe_features())
    assert out.count() == 80 and out.where("body_ratio < 0 OR body_ratio > 1.0000001").count() == 0


def test_scores(spark):
    import math

    def plain(x, bad, mid, good, low, high):
        if x is None or not math.isfinite(x) or not bad < mid < good:
            return 1e-12
        if x <= bad:
            v = 0.25 * math.exp(-low * (bad - x))
        elif x < mid:
            v = 0.25 + 0.25 * (x - bad) / (mid - bad)
        elif x < good:
            v = 0.5 + 0.25 * (x - mid) / (good - mid)
        else:
            v = 0.75 + 0.25 * (1 - math.exp(-high * (x - good)))
        return min(1 - 1e-12, max(1e-12, v))

    xs = [None, float("nan"), float("inf"), -50.0, -1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 99.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(M.score_higher(F.col("x"), 0.0, 1.0, 2.0, 0.5, 3.0).alias("h"), M.score_lower(F.col("x"), 0.0, 1.0, 2.0, 0.5, 3.0).alias("l"), M.score_higher(F.col("x"), 1.0, 1.0, 2.0).alias("b")).collect()
    for x, r in zip(xs, got, strict=True):
        assert abs(r.h - plain(x, 0.0, 1.0, 2.0, 0.5, 3.0)) < 1e-12 and abs(r.l - plain(None if x is None else -x, -2.0, -1.0, 0.0, 0.5, 3.0)) < 1e-12 and r.b == 1e-12


def test_walk_forward_edges(spark):
    """Fold k begins at row k * n // folds, in one series as in each of several."""
    for n in (1, 4, 7, 23):
        df = spark.createDataFrame([("A", k, float(k)) for k in range(n)], "symbol string, dt int, pnl double").repartition(3)
        want = {}
        for k in range(5):
            for _ in range(k * n // 5, (k + 1) * n // 5):
                want[k] = want.get(k, 0) + 1
        for keys in (("symbol",), ()):
            assert {r.fold: r.hits for r in M.walk_forward(df, "dt", "pnl", 5, keys).collect()} == want


def test_ordered_ranges(spark):
    from barloom.plans.ordered import carried_forward, numbered_rows

    r = random.Random(3)
    rows = [(k, r.choice([None, float(k)]), None if k < 40 else 1.0) for k in range(500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "dt int, a double, b double").repartition(7)
    assert all(x.n == x.dt for x in numbered_rows(df, "dt", "n").collect())
    last, got = None, {x.dt: x for x in carried_forward(df, "dt", ["a", "b"]).collect()}
    for dt_, a, b in sorted(rows, key=lambda x: x[0]):
        last = a if a is not None else last
        assert got[dt_].a == last and got[dt_].b == b
    assert numbered_rows(df.limit(0), "dt", "n").count() == 0 and carried_forward(df.limit(0), "dt", ["a"]).count() == 0


def test_quantiles_of_bounded_size(spark):
    df = spark.range(10_000).selectExpr("cast(id as double) AS x")
    assert M.quantile_edges(df, ["x"], 4)["x"] == [0, 2499.75, 4999.5, 7499.25, 9999]
    assert all(abs(a - b) <= 10 for a, b in zip(M.quantile_edges(df, ["x"], 4, accuracy=1000)["x"], [0, 2499.75, 4999.5, 7499.25, 9999], strict=True))
