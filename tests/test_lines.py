import math

import pytest
from helpers import BARS, close_to, column, walk
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.functions.folds import Ema, HalfWay, Laguerre, StopAndReverse
from barloom.functions.scalar import div_by_zero, div_zero_by_zero, if_else
from barloom.operators.indicators import AVERAGES, CANONICAL, CLOSE, HIGH, LOW, OPEN, REGISTRY, cross, crossing, indicator, sma
from barloom.plans.lines import lag, with_lines


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(120) + walk(90, "B", 2), BARS).cache()


def test_a_rolling_mean_waits_for_a_full_frame(bars):
    rows = walk(120)
    want = [None if k < 9 else sum(r[5] for r in rows[k - 9 : k + 1]) / 10 for k in range(120)]
    assert close_to(column(with_lines(bars, {"v": sma(CLOSE, 10)}), "v"), want)


def test_symbols_do_not_mix(bars):
    out = with_lines(bars, {"v": sma(CLOSE, 10), "e": indicator("EMA", period=10)["ema"]})
    assert column(out, "v", "B")[:9] == [None] * 9 and column(out, "e", "B")[:9] == [None] * 9 and column(out, "e", "B")[9] is not None


def test_exponential_mean_is_seeded_with_a_mean(bars):
    closes = [r[5] for r in walk(120)]
    value, want = None, []
    for k, x in enumerate(closes):
        value = None if k < 9 else sum(closes[:10]) / 10 if k == 9 else value + (x - value) * 2 / 11
        want.append(value)
    assert close_to(column(with_lines(bars, {"v": indicator("EMA", period=10)["ema"]}), "v"), want)


def test_warm_up_adds_up(bars):
    out = with_lines(bars, {"d": indicator("DEMA", period=10)["dema"], "m": indicator("MACDHisto")["histo"], "c": crossing(CLOSE, sma(CLOSE, 15)), "k": indicator("KAMA")["kama"]})
    first = {c: next(k for k, v in enumerate(column(out, c)) if v is not None) for c in "dmck"}
    assert first == {"d": 18, "m": 33, "c": 15, "k": 30}


def test_one_stage_for_all_windows_of_one_depth(bars):
    plan = with_lines(bars, {f"s{p}": sma(CLOSE, p) for p in (5, 10, 20)} | {"h": indicator("Highest")["highest"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_folds_in_a_row_share_one_exchange(bars):
    plan = with_lines(bars, indicator("TRIX", rocperiod=0) | indicator("TEMA"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_crossings_exclude_one_another(bars):
    out = with_lines(bars, {"u": cross(CLOSE, sma(CLOSE, 5), True), "d": cross(CLOSE, sma(CLOSE, 5), False)})
    both = list(zip(column(out, "u"), column(out, "d"), strict=True))
    assert not any(u and d for u, d in both) and any(u for u, _ in both) and any(d for _, d in both)


def test_division_by_zero_is_null_or_what_is_asked_for(spark):
    df = spark.createDataFrame([("A", 1, 2.0, 0.0), ("A", 2, 0.0, 0.0), ("A", 3, 6.0, 3.0)], "symbol string, dt int, open double, close double")
    out = with_lines(df, {"q": OPEN / CLOSE, "z": div_by_zero(OPEN, CLOSE, 9.0), "s": div_zero_by_zero(OPEN, CLOSE, 7.0, 5.0), "i": if_else(CLOSE, 1, 2), "m": OPEN % CLOSE})
    assert [column(out, c) for c in "qzsim"] == [[None, None, 2.0], [9.0, 9.0, 2.0], [7.0, 5.0, 2.0], [2.0, 2.0, 1.0], [None, None, 0.0]]


def test_names_and_aliases():
    assert CANONICAL["macdhistogram"] == CANONICAL["macdhisto"] and CANONICAL["hullma"] == CANONICAL["hma"]
    assert len(REGISTRY) >= 130 and all(f"{n.lower()}envelope" in CANONICAL and f"{n.lower()}osc" in CANONICAL for n in ("SMA", "EMA", "SMMA", "WMA", "DEMA", "TEMA", "KAMA", "ZLEMA", "HMA", "DMA"))
    assert "sma" in AVERAGES


def test_every_indicator_runs(bars):
    lines = {f"{k}_{n}": v for k, name in enumerate(REGISTRY) for n, v in indicator(name).items()}
    lines = {f"x{k}": v for k, v in enumerate(lines.values())}
    assert with_lines(bars, dict(list(lines.items())[:60])).count() == 210


def test_ranges(bars):
    out = with_lines(bars, indicator("RSI") | indicator("StochasticFast") | indicator("AroonUpDown") | {"w": indicator("WilliamsR")["percr"]})
    for c, lo, hi in (("rsi", 0, 100), ("perck", 0, 100), ("aroonup", 0, 100), ("w", -100, 0)):
        assert all(lo - 1e-9 <= v <= hi + 1e-9 for v in column(out, c) if v is not None)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(1, 1000), min_size=1, max_size=60), st.integers(1, 10))
def test_a_mean_of_one_value_is_the_value(xs, p):
    e = Ema(1, 1.0)
    assert [e.step(x) for x in xs] == xs
    e = Ema(p, 0.5)
    out = [e.step(x) for x in xs]
    assert all(v is None for v in out[: p - 1]) and all(min(xs) - 1e-6 <= v <= max(xs) + 1e-6 for v in out[p - 1 :])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.floats(10, 20), st.floats(0, 3), st.floats(0, 3)), min_size=3, max_size=40))
def test_a_stop_stays_on_its_side(rows):
    f = StopAndReverse(2, 0.02, 0.2)
    for k, (c, up, down) in enumerate(rows):
        v = f.step(c + up, c - down, c)
        assert (v is None) == (k == 0)


def test_laguerre_and_half_way():
    f = Laguerre(0.5, 1, 0)
    assert [f.step(x) for x in (4.0, 4.0)] == [2.0, 3.0]
    h = HalfWay()
    assert [h.step(10.0, 20.0), h.step(0.0, 30.0), h.step(0.0, 0.0)] == [10.0, 15.0, 22.5]


def test_lag_of_nothing_is_the_line():
    assert lag(HIGH, 0).key == HIGH.key and math.isclose(1.0, 1.0) and LOW.depth == 0
