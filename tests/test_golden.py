"""Published values of indicators and of a strategy on a year of daily bars. The file is not kept here: give its path in GOLDEN_BARS_CSV."""

import os

import pytest
from pyspark.sql import functions as F

from barloom.operators import broker as B
from barloom.operators.indicators import CLOSE, crossing, indicator, sma
from barloom.plans.lines import with_lines

PATH = os.environ.get("GOLDEN_BARS_CSV")
pytestmark = pytest.mark.skipif(not PATH, reason="GOLDEN_BARS_CSV is not set")

# First valid row (from 1); last, first valid and middle value of the first line.
GOLDEN = {
    "ATR": (15, [35.866308, 34.264286, 54.329064]), "AO": (34, [50.804206, 72.983735, 33.655941]), "BBands": (20, [4065.884, 3621.185, 3582.8955]), "CCI": (39, [69.574287, 91.196363, 82.175663]),
    "DEMA": (59, [4115.563246, 3852.837209, 3665.728415]), "DM": (42, [15.302485, 31.674648, 15.961767]), "DMA": (30, [4121.903804, 3677.634675, 3579.962958]), "DPO": (29, [83.271, 105.625, 1.187]), "DV2": (253, [17.460317, 55.952381, 80.555556]),
    "EMA": (30, [4070.115719, 3644.444667, 3581.728712]), "HMA": (34, [4135.66125, 3736.429214, 3578.389024]), "KAMA": (31, [4054.187922, 3648.549, 3592.97919]), "KST": (48, [18.9663, 33.688645, 27.643797]), "LRSI": (6, [0.748915, 0.714286, 1.0]),
    "PGO": (15, [0.543029, -2.347884, 0.416325]), "PPO": (34, [0.633439, 0.883552, 0.04943]), "RMI": (25, [67.786097, 59.85623, 38.287526]), "RSI": (15, [57.644284, 41.630968, 53.352553]), "SMMA": (30, [4021.569725, 3644.444667, 3616.427648]),
    "Stochastic": (18, [88.667626, 21.409626, 63.796187]), "TEMA": (88, [4113.721705, 3862.386854, 3832.691054]), "Trix": (44, [0.071304, 0.18148, 0.050954]), "TSI": (38, [16.012364, 22.866307, 4.99075]), "UltimateOscillator": (29, [51.991177, 62.334055, 46.707445]),
    "Vortex": (15, [1.245434, 0.921076, 1.062278]), "WilliamsAD": (2, [755.05, 12.5, 242.98]), "WMA": (30, [4076.212366, 3655.193634, 3576.228]), "ZLEMA": (44, [4125.487746, 3778.694, 3620.284712]), "ZeroLagIndicator": (30, [4110.282052, 3644.444667, 3564.906194]),
}
BUYS = [3643.35, 3801.03, 3872.37, 3863.57, 3845.32, 3656.43, 3542.65, 3639.65, 3799.86, 3840.20, 4047.63, 4052.55]
SELLS = [3763.95, 3811.85, 3822.35, 3822.57, 3829.82, 3598.58, 3545.92, 3766.80, 3782.15, 3979.73, 4045.05]
SWEEP = [14525.80] * 2 + [15408.20] * 2 + [14763.90] * 10 + [13187.10] * 3 + [13684.40] * 6 + [13656.10] * 4 + [12988.10] * 13


@pytest.fixture(scope="module")
def bars(spark):
    raw = spark.read.csv(PATH, header=True, schema="Date string, open double, high double, low double, close double, volume double, openinterest double")
    return raw.select(F.lit("A").alias("symbol"), F.to_timestamp("Date").cast("timestamp_ntz").alias("dt"), "open", "high", "low", "close", "volume", "openinterest").cache()


@pytest.mark.parametrize("name", GOLDEN)
def test_indicator(bars, name):
    first, want = GOLDEN[name]
    lines = indicator(name)
    line = next(iter(lines.values()))
    got = [r[0] for r in with_lines(bars, {"v": line}).orderBy("dt").select("v").collect()]
    n = len(got)
    assert [f"{got[k]:.6f}" for k in (n - 1, first - 1, n - 1 + (first - n) // 2)] == [f"{v:.6f}" for v in want]


@pytest.mark.parametrize(("commission", "cash", "value"), [(B.Commission(2.0, 10.0, 1000.0), 11795.0, 12795.0), (B.Commission(), 6164.16, 10284.10)])
def test_cross_strategy(bars, commission, cash, value):
    signals = with_lines(bars, {"signal": crossing(CLOSE, sma(CLOSE, 15))})
    ev = B.simulate(signals, lambda first: B.CrossStrategy(), lambda first: B.Broker(commission=commission)).cache()
    orders = B.orders(ev).where("status = 'Completed'").orderBy("ref").collect()
    assert [round(o.price, 2) for o in orders if o.side == B.BUY] == BUYS and [round(o.price, 2) for o in orders if o.side == B.SELL] == SELLS
    last = B.equity(ev).orderBy(F.desc("dt")).first()
    assert round(last.cash, 2) == cash and round(last.value, 2) == value and B.trades(ev).count() == 11


def test_sweep(bars):
    periods = list(range(5, 45))
    signals = with_lines(bars, {f"s{p}": crossing(CLOSE, sma(CLOSE, p)) for p in periods})
    own = lambda first: B.CrossStrategy(f"s{first['period']:.0f}", sticky=True)
    ev = B.simulate(signals, own, lambda first: B.Broker(commission=B.Commission(2.0, 10.0, 1000.0)), variants=B.sweep(period=periods))
    last = B.equity(ev, ("param_id",)).groupBy("param_id").agg(F.max_by(F.struct("value", "cash"), "dt").alias("v")).orderBy("param_id").collect()
    assert [round(r.v.value, 2) for r in last] == SWEEP and all(round(r.v.value - r.v.cash, 2) == 1000 for r in last)
