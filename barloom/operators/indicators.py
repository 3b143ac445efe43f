"""Indicators as lines over bars (symbol, dt, open, high, low, close, volume).

`indicator(name, **parameters)` gives an indicator's lines by name; names and aliases are matched without case.
Every moving average also has an envelope ({name}Envelope) and an oscillator ({name}Oscillator, {name}Osc).
"""

from __future__ import annotations

import functools
import inspect
import math
from collections.abc import Callable

from barloom.functions.scalar import all_of, choose_by_order, div_by_zero, div_zero_by_zero, if_else, max_of, min_of
from barloom.plans.lines import Line, col, cumulative, extreme_row, fold, lag, last_known, lead, line, op, rolling, row_number, values

OPEN, HIGH, LOW, CLOSE, VOLUME = (col(c) for c in ("open", "high", "low", "close", "volume"))
Lines = dict[str, Line]

REGISTRY: dict[str, Callable[..., Lines]] = {}
#: Names that stand for one another, as the key of the registry.
CANONICAL: dict[str, str] = {}
AVERAGES: dict[str, Callable[..., Line]] = {}


def register(*names: str):
    def add(f):
        REGISTRY[names[0]] = f
        for n in names:
            CANONICAL[n.lower()] = names[0]
        return f

    return add


def indicator(name: str, **parameters) -> Lines:
    return REGISTRY[CANONICAL[name.lower()]](**parameters)


def average(*names: str):
    """Registers a moving average f(x, period, ...) -> line, its indicator, envelope and oscillator."""

    def add(f):
        for n in names:
            AVERAGES[n.lower()] = f
        short = names[1] if len(names) > 1 else names[0]
        first, period = short.lower(), inspect.signature(f).parameters["period"].default

        @register(*names)
        def plain(data=CLOSE, period=period, **more):
            return {first: f(data, period, **more)}

        @register(*(n + "Envelope" for n in (short, *(n for n in names if n != short))))
        def envelope(data=CLOSE, period=period, perc=2.5, **more):
            return {first: (a := f(data, period, **more)), "top": a * (1 + perc / 100), "bot": a * (1 - perc / 100)}

        @register(*(n + s for n in (short, *(n for n in names if n != short)) for s in ("Osc", "Oscillator")))
        def oscillator(data=CLOSE, period=period, **more):
            return {"osc": line(data) - f(data, period, **more)}

        return f

    return add


def ma(name: str, x, period: int) -> Line:
    return AVERAGES[name.lower()](x, period)


# Moving averages


@average("MovingAverageSimple", "SMA", "SimpleMovingAverage")
def sma(x, period=30):
    return rolling("avg", period, x)


@average("ExponentialMovingAverage", "EMA", "MovingAverageExponential")
def ema(x, period=30):
    return fold("Ema", x, params=(period, 2.0 / (1 + period)))


@average("SmoothedMovingAverage", "SMMA", "WilderMA", "MovingAverageSmoothed", "MovingAverageWilder", "ModifiedMovingAverage")
def smma(x, period=30):
    return fold("Ema", x, params=(period, 1.0 / period))


def weighted(x, weights: list[float], factor: float) -> Line:
    """factor * the sum of the last values times their weights, the newest first."""
    return functools.reduce(lambda a, b: a + b, (lag(x, k) * w for k, w in enumerate(weights))) * factor


@average("WeightedMovingAverage", "WMA", "MovingAverageWeighted")
def wma(x, period=30):
    return weighted(x, [float(period - k) for k in range(period)], 2.0 / (period * (period + 1)))


@average("HullMovingAverage", "HMA", "HullMA")
def hma(x, period=30):
    return wma(2 * wma(x, period // 2) - wma(x, period), int(math.sqrt(period)))


@average("DoubleExponentialMovingAverage", "DEMA", "MovingAverageDoubleExponential")
def dema(x, period=30):
    e = ema(x, period)
    return 2 * e - ema(e, period)


@average("TripleExponentialMovingAverage", "TEMA", "MovingAverageTripleExponential")
def tema(x, period=30):
    a = ema(x, period)
    b = ema(a, period)
    return 3 * a - 3 * b + ema(b, period)


@average("ZeroLagExponentialMovingAverage", "ZLEMA", "ZeroLagEma")
def zlema(x, period=30):
    return ema(2 * line(x) - lag(x, (period - 1) // 2), period)


@average("ZeroLagIndicator", "ZLInd", "ZLIndicator", "EC", "ErrorCorrecting")
def zlind(x, period=30, gainlimit=50):
    return fold("LeastErrorGain", x, ema(x, period), params=(2.0 / (1 + period), gainlimit))


@average("DicksonMovingAverage", "DMA", "DicksonMA")
def dma(x, period=30, gainlimit=50, hperiod=7):
    return (zlind(x, period, gainlimit) + hma(x, hperiod)) / 2


@average("AdaptiveMovingAverage", "KAMA", "MovingAverageAdaptive")
def kama(x, period=30, fast=2, slow=30):
    x = line(x)
    ratio = abs((x - lag(x, period)) / rolling("sum", period, abs(x - lag(x, 1))))
    quick, idle = 2.0 / (fast + 1), 2.0 / (slow + 1)
    return fold("DynamicEma", x, (ratio * (quick - idle) + idle) ** 2, sma(x, period))


# Rolling primitives


@register("PeriodN")
def period_n(data=CLOSE, period=1):
    return {"value": rolling("max", period, line(data) * 0) + data}


@register("Highest", "MaxN")
def highest(data=HIGH, period=14):
    return {"highest": rolling("max", period, data)}


@register("Lowest", "MinN")
def lowest(data=LOW, period=14):
    return {"lowest": rolling("min", period, data)}


@register("SumN")
def sum_n(data=CLOSE, period=14):
    return {"sumn": rolling("sum", period, data)}


@register("AnyN")
def any_n(data=None, period=5):
    return {"anyn": rolling("max", period, (line(CLOSE - lag(CLOSE, 1) > 0) if data is None else line(data)) != 0)}


@register("AllN")
def all_n(data=None, period=3):
    return {"alln": rolling("min", period, (line(CLOSE - lag(CLOSE, 1) > 0) if data is None else line(data)) != 0)}


@register("ApplyN", "BaseApplyN", "OperationN")
def apply_n(data=CLOSE, period=5, func="sum of squares"):
    """A function of the last values: a template over {0}, an array, or by default their sum of squares."""
    if func == "sum of squares":
        return {"apply": rolling("sum", period, line(data) * data)}
    return {"apply": op(func, values(period, data))}


@register("ReduceN")
def reduce_n(data=CLOSE, period=5, function=None, initializer=0.0):
    """A left fold of a line function over the last values, oldest first."""
    function = function or (lambda a, b: a * 0.5 + b)
    return {"reduced": functools.reduce(function, (lag(data, k) for k in range(period - 1, -1, -1)), line(initializer))}


@register("FindFirstIndex", "FindFirstIndexHighest")
def first_highest(data=HIGH, period=14):
    return {"index": row_number() - extreme_row(period, data)}


@register("FindFirstIndexLowest")
def first_lowest(data=LOW, period=14):
    return {"index": row_number() - extreme_row(period, -line(data))}


@register("FindLastIndex", "FindLastIndexHighest")
def last_highest(data=HIGH, period=14):
    return {"index": row_number() - extreme_row(period, data, oldest=True)}


@register("FindLastIndexLowest")
def last_lowest(data=LOW, period=14):
    return {"index": row_number() - extreme_row(period, -line(data), oldest=True)}


@register("Accum", "CumSum", "CumulativeSum")
def accum(data=CLOSE, seed=0.0):
    return {"accum": cumulative("sum", data) + seed}


@register("Average", "ArithmeticMean", "Mean")
def mean(data=CLOSE, period=14):
    return {"av": rolling("avg", period, data)}


@register("ExponentialSmoothing", "ExpSmoothing")
def smoothing(data=CLOSE, period=14, alpha=None):
    return {"av": fold("Ema", data, params=(period, alpha or 2.0 / (1 + period)))}


@register("ExponentialSmoothingDynamic", "ExpSmoothingDynamic")
def dynamic_smoothing(data=CLOSE, period=14, alpha=None):
    alpha = abs(CLOSE - lag(CLOSE, 1)) / (HIGH - LOW + 1) if alpha is None else alpha
    return {"av": fold("DynamicEma", data, min_of(alpha, 1), sma(data, period))}


@register("WeightedAverage", "AverageWeighted")
def weighted_average(data=CLOSE, period=5, coef=1.0, weights=(1.0, 2.0, 3.0, 4.0, 5.0)):
    return {"av": weighted(data, list(weights)[::-1], coef)}


@register("PercentRank", "PctRank")
def percent_rank(data=CLOSE, period=50):
    return {"pctrank": share_below(data, period)}


def share_below(x, period: int) -> Line:
    return op(f"CAST(size(filter({{0}}, v -> v < {{1}})) AS DOUBLE) / {period}", values(period, x), x)


def deviation(x, period: int, average: str = "sma", mean_line=None) -> Line:
    m = ma(average, x, period) if mean_line is None else mean_line
    return abs(ma(average, line(x) * x, period) - m * m) ** 0.5


@register("StandardDeviation", "StdDev")
def standard_deviation(data=CLOSE, period=20, movav="sma"):
    return {"stddev": deviation(data, period, movav)}


@register("MeanDeviation", "MeanDev")
def mean_deviation(data=CLOSE, period=20, movav="sma"):
    return {"meandev": ma(movav, abs(line(data) - ma(movav, data, period)), period)}


def non_zero_difference(a, b) -> Line:
    d = line(a) - b
    return op("CASE WHEN {0} IS NOT NULL THEN coalesce({1}, CAST(0 AS DOUBLE)) END", d, last_known(op("nullif({0}, CAST(0 AS DOUBLE))", d)))


@register("NonZeroDifference", "NZD")
def nzd(data0=CLOSE, data1=None):
    return {"nzd": non_zero_difference(data0, sma(CLOSE, 10) if data1 is None else data1)}


def cross(a, b, up: bool) -> Line:
    before = lag(non_zero_difference(a, b), 1)
    return all_of(before < 0 if up else before > 0, line(a) > b if up else line(a) < b)


def crossing(a, b) -> Line:
    return cross(a, b, True) - cross(a, b, False)


@register("CrossUp")
def cross_up(data0=CLOSE, data1=None):
    return {"crossed": cross(data0, sma(CLOSE, 10) if data1 is None else data1, True)}


@register("CrossDown")
def cross_down(data0=CLOSE, data1=None):
    return {"crossed": cross(data0, sma(CLOSE, 10) if data1 is None else data1, False)}


@register("CrossOver")
def cross_over(data0=CLOSE, data1=None):
    return {"crossover": crossing(data0, sma(CLOSE, 10) if data1 is None else data1)}


@register("OLS_Slope_InterceptN")
def ols(data0=CLOSE, data1=OPEN, period=10):
    return {"slope": rolling("regr_slope", period, data0, data1), "intercept": rolling("regr_intercept", period, data0, data1)}


@register("OLS_TransformationN")
def ols_transformation(data0=CLOSE, data1=OPEN, period=10, inner=10):
    """The inner regression has a period of its own, 10 unless it is given."""
    fit = ols(data0, data1, inner)
    spread = line(data0) - (fit["slope"] * data1 + fit["intercept"])
    m, s = sma(spread, period), deviation(spread, period)
    return {"spread": spread, "spread_mean": m, "spread_std": s, "zscore": (spread - m) / s}


@register("OLS_BetaN")
def ols_beta(data0=CLOSE, data1=OPEN, period=10):
    return {"beta": rolling("regr_slope", period, data0, data1)}


@register("HurstExponent", "Hurst")
def hurst(data=CLOSE, period=40, lag_start=2, lag_end=None):
    lags = list(range(lag_start or 2, lag_end or period // 2))
    logs = [math.log10(k) for k in lags]
    middle = sum(logs) / len(logs)
    spread = sum((v - middle) ** 2 for v in logs)
    x = line(data)
    parts = [op("log10(nullif(sqrt({0}), CAST(0 AS DOUBLE)))", rolling("stddev_pop", period - k, x - lag(x, k))) * ((v - middle) / spread) for k, v in zip(lags, logs, strict=True)]
    return {"hurst": 2 * functools.reduce(lambda a, b: a + b, parts)}


@register("Envelope")
def envelope(data=None, perc=2.5):
    data = sma(CLOSE, 30) if data is None else line(data)
    return {"src": data, "top": data * (1 + perc / 100), "bot": data * (1 - perc / 100)}


@register("Oscillator")
def oscillator(data0=CLOSE, data1=None):
    return {"osc": line(data0) - (sma(CLOSE, 30) if data1 is None else data1)}


# Momentum


@register("Momentum")
def momentum(data=CLOSE, period=12):
    return {"momentum": line(data) - lag(data, period)}


@register("MomentumOscillator", "MomentumOsc")
def momentum_oscillator(data=CLOSE, period=12, band=100.0):
    return {"momosc": band * (line(data) / lag(data, period))}


def change(x, period: int) -> Line:
    return (line(x) - lag(x, period)) / lag(x, period)


@register("RateOfChange", "ROC")
def roc(data=CLOSE, period=12):
    return {"roc": change(data, period)}


@register("RateOfChange100", "ROC100")
def roc100(data=CLOSE, period=12):
    return {"roc100": 100 * change(data, period)}


@register("PercentChange", "PctChange")
def percent_change(data=CLOSE, period=30):
    return {"pctchange": line(data) / lag(data, period) - 1}


def gain(x, period: int) -> Line:
    return max_of(line(x) - lag(x, period), 0)


def loss(x, period: int) -> Line:
    return max_of(lag(x, period) - x, 0)


@register("UpDay")
def up_day(data=CLOSE, period=1):
    return {"upday": gain(data, period)}


@register("DownDay")
def down_day(data=CLOSE, period=1):
    return {"downday": loss(data, period)}


@register("UpDayBool")
def up_day_bool(data=CLOSE, period=1):
    return {"upday": line(data) > lag(data, period)}


@register("DownDayBool")
def down_day_bool(data=CLOSE, period=1):
    return {"downday": lag(data, period) > data}


def strength(data, period, movav, lookback, safediv=False, safehigh=100.0, safelow=50.0) -> Line:
    up, down = ma(movav, gain(data, lookback), period), ma(movav, loss(data, lookback), period)
    if not safediv:
        return 100 - 100 / (1 + up / down)
    point = lambda v: None if v == 100 else -100.0 / (v - 100.0) - 1.0
    rs = div_zero_by_zero(up, down, point(safehigh), point(safelow))
    infinite = 100.0 if point(safehigh) is None else None
    return op("CASE WHEN {0} IS NULL AND {1} = 0 AND {2} <> 0 THEN {3} ELSE {4} END", rs, down, up, infinite, 100 - 100 / (1 + rs))


@register("RelativeStrengthIndex", "RSI", "RSI_SMMA", "RSI_Wilder")
def rsi(data=CLOSE, period=14, movav="smma", lookback=1, safediv=False, safehigh=100.0, safelow=50.0):
    return {"rsi": strength(data, period, movav, lookback, safediv, safehigh, safelow)}


@register("RSI_Safe")
def rsi_safe(data=CLOSE, period=14):
    return rsi(data, period, safediv=True)


@register("RSI_SMA", "RSI_Cutler")
def rsi_sma(data=CLOSE, period=14):
    return rsi(data, period, "sma")


@register("RSI_EMA")
def rsi_ema(data=CLOSE, period=14):
    return rsi(data, period, "ema")


@register("RelativeMomentumIndex", "RMI")
def rmi(data=CLOSE, period=20, lookback=5, movav="smma"):
    return {"rmi": strength(data, period, movav, lookback)}


def _laguerre(x, gamma: float, start: int) -> list[Line]:
    return [fold("Laguerre", x, params=(gamma, start, k)) for k in range(4)]


@register("LaguerreRSI", "LRSI")
def lrsi(data=CLOSE, gamma=0.5, period=6):
    s = _laguerre(data, gamma, period)
    up = functools.reduce(lambda a, b: a + b, (max_of(a - b, 0) for a, b in zip(s, s[1:], strict=False)))
    down = functools.reduce(lambda a, b: a + b, (max_of(b - a, 0) for a, b in zip(s, s[1:], strict=False)))
    return {"lrsi": div_by_zero(up, up + down, 1.0)}


@register("LaguerreFilter", "LAGF")
def laguerre_filter(data=CLOSE, gamma=0.5):
    a, b, c, d = _laguerre(data, gamma, 1)
    return {"lfilter": (a + 2 * b + 2 * c + d) / 6}


def macd_lines(data, fast, slow, signal, movav) -> tuple[Line, Line]:
    m = ma(movav, data, fast) - ma(movav, data, slow)
    return m, ma(movav, m, signal)


@register("MACD")
def macd(data=CLOSE, period_me1=12, period_me2=26, period_signal=9, movav="ema"):
    m, s = macd_lines(data, period_me1, period_me2, period_signal, movav)
    return {"macd": m, "signal": s}


@register("MACDHisto", "MACDHistogram")
def macd_histo(data=CLOSE, period_me1=12, period_me2=26, period_signal=9, movav="ema"):
    m, s = macd_lines(data, period_me1, period_me2, period_signal, movav)
    return {"macd": m, "signal": s, "histo": m - s}


@register("PriceOscillator", "PriceOsc", "AbsolutePriceOscillator", "APO", "AbsPriceOsc")
def price_oscillator(data=CLOSE, period1=12, period2=26, movav="ema"):
    return {"po": ma(movav, data, period1) - ma(movav, data, period2)}


def _percentage(data, period1, period2, signal, movav, short: bool) -> Lines:
    a, b = ma(movav, data, period1), ma(movav, data, period2)
    p = 100 * (a - b) / (a if short else b)
    s = ma(movav, p, signal)
    return {"ppo": p, "signal": s, "histo": p - s}


@register("PercentagePriceOscillator", "PPO", "PercPriceOsc")
def ppo(data=CLOSE, period1=12, period2=26, period_signal=9, movav="ema"):
    return _percentage(data, period1, period2, period_signal, movav, False)


@register("PercentagePriceOscillatorShort", "PPOShort", "PercPriceOscShort")
def ppo_short(data=CLOSE, period1=12, period2=26, period_signal=9, movav="ema"):
    return _percentage(data, period1, period2, period_signal, movav, True)


@register("Trix", "TRIX")
def trix(data=CLOSE, period=15, rocperiod=1, movav="ema"):
    e = ma(movav, ma(movav, ma(movav, data, period), period), period)
    return {"trix": 100 * (e / lag(e, rocperiod) - 1)}


@register("TrixSignal")
def trix_signal(data=CLOSE, period=15, rocperiod=1, sigperiod=9, movav="ema"):
    t = trix(data, period, rocperiod, movav)["trix"]
    return {"trix": t, "signal": ma(movav, t, sigperiod)}


@register("TrueStrengthIndicator", "TSI")
def tsi(data=CLOSE, period1=25, period2=13, pchange=1, movav="ema"):
    d = line(data) - lag(data, pchange)
    twice = lambda x: ma(movav, ma(movav, x, period1), period2)
    return {"tsi": 100 * (twice(d) / twice(abs(d)))}


@register("KnowSureThing", "KST")
def kst(data=CLOSE, rp=(10, 15, 20, 30), rma=(10, 10, 10, 10), factors=(1.0, 2.0, 3.0, 4.0), rsignal=9, movav="sma"):
    parts = [ma(movav, 100 * change(data, r), m) * f for r, m, f in zip(rp, rma, factors, strict=True)]
    k = functools.reduce(lambda a, b: a + b, parts)
    return {"kst": k, "signal": ma(movav, k, rsignal)}


@register("DetrendedPriceOscillator", "DPO")
def dpo(data=CLOSE, period=20, movav="sma"):
    return {"dpo": line(data) - lag(ma(movav, data, period), -(-period // 2 + 1))}


@register("DV2")
def dv2(period=252, maperiod=2, movav="sma"):
    return {"dv2": 100 * share_below(ma(movav, CLOSE / ((HIGH + LOW) / 2), maperiod), period)}


def _stochastic(period, dfast, movav, safediv, safezero) -> tuple[Line, Line]:
    top, bottom = rolling("max", period, HIGH), rolling("min", period, LOW)
    share = div_by_zero(CLOSE - bottom, top - bottom, safezero) if safediv else (CLOSE - bottom) / (top - bottom)
    return 100 * share, ma(movav, 100 * share, dfast)


@register("StochasticFast")
def stochastic_fast(period=14, period_dfast=3, movav="sma", safediv=False, safezero=0.0):
    k, d = _stochastic(period, period_dfast, movav, safediv, safezero)
    return {"perck": k, "percd": d}


@register("Stochastic", "StochasticSlow")
def stochastic(period=14, period_dfast=3, period_dslow=3, movav="sma", safediv=False, safezero=0.0):
    _, d = _stochastic(period, period_dfast, movav, safediv, safezero)
    return {"perck": d, "percd": ma(movav, d, period_dslow)}


@register("StochasticFull")
def stochastic_full(period=14, period_dfast=3, period_dslow=3, movav="sma", safediv=False, safezero=0.0):
    k, d = _stochastic(period, period_dfast, movav, safediv, safezero)
    return {"perck": k, "percd": d, "percdslow": ma(movav, d, period_dslow)}


@register("WilliamsR")
def williams_r(period=14):
    top, bottom = rolling("max", period, HIGH), rolling("min", period, LOW)
    return {"percr": -100 * (top - CLOSE) / (top - bottom)}


TRUE_HIGH, TRUE_LOW = max_of(HIGH, lag(CLOSE, 1)), min_of(LOW, lag(CLOSE, 1))
TRUE_RANGE = TRUE_HIGH - TRUE_LOW


@register("WilliamsAD")
def williams_ad():
    rise, fall = gain(CLOSE, 1), loss(CLOSE, 1)
    return {"ad": op("CASE WHEN {1} IS NOT NULL THEN {0} END", cumulative("sum", if_else(rise, CLOSE - TRUE_LOW, 0) + if_else(fall, CLOSE - TRUE_HIGH, 0)), rise)}


@register("UltimateOscillator")
def ultimate(p1=7, p2=14, p3=28):
    part = lambda p: rolling("sum", p, CLOSE - TRUE_LOW) / rolling("sum", p, TRUE_RANGE)
    return {"uo": (4 * part(p1) + 2 * part(p2) + part(p3)) * (100.0 / 7)}


@register("CommodityChannelIndex", "CCI")
def cci(period=20, factor=0.015, movav="sma"):
    typical = (HIGH + LOW + CLOSE) / 3
    m = ma(movav, typical, period)
    return {"cci": (typical - m) / (factor * ma(movav, abs(typical - m), period))}


def _awesome(fast, slow, movav) -> Line:
    middle = (HIGH + LOW) / 2
    return ma(movav, middle, fast) - ma(movav, middle, slow)


@register("AwesomeOscillator", "AwesomeOsc", "AO")
def awesome(fast=5, slow=34, movav="sma"):
    return {"ao": _awesome(fast, slow, movav)}


@register("AccelerationDecelerationOscillator", "AccDeOsc")
def acceleration(period=5, movav="sma"):
    a = _awesome(5, 34, "sma")
    return {"accde": a - ma(movav, a, period)}


@register("PrettyGoodOscillator", "PGO", "PrettyGoodOsc")
def pretty_good(period=14, movav="sma"):
    return {"pgo": (CLOSE - ma(movav, CLOSE, period)) / smma(TRUE_RANGE, period)}


# Volatility, trend, price structure


@register("TrueHigh")
def true_high():
    return {"truehigh": TRUE_HIGH}


@register("TrueLow")
def true_low():
    return {"truelow": TRUE_LOW}


@register("TrueRange", "TR")
def true_range():
    return {"tr": TRUE_RANGE}


@register("AverageTrueRange", "ATR")
def atr(period=14, movav="smma"):
    return {"atr": ma(movav, TRUE_RANGE, period)}


@register("BollingerBands", "BBands")
def bollinger(data=CLOSE, period=20, devfactor=2.0, movav="sma"):
    m = ma(movav, data, period)
    width = devfactor * deviation(data, period, movav, m)
    return {"mid": m, "top": m + width, "bot": m - width}


@register("BollingerBandsPct")
def bollinger_pct(data=CLOSE, period=20, devfactor=2.0, movav="sma"):
    b = bollinger(data, period, devfactor, movav)
    return b | {"pctb": (line(data) - b["bot"]) / (b["top"] - b["bot"])}


@register("UpMove")
def up_move(data=CLOSE):
    return {"upmove": line(data) - lag(data, 1)}


@register("DownMove")
def down_move(data=CLOSE):
    return {"downmove": lag(data, 1) - data}


def _directions(period, movav) -> tuple[Line, Line]:
    up, down = HIGH - lag(HIGH, 1), lag(LOW, 1) - LOW
    plus = if_else(all_of(up > down, up > 0), up, 0)
    minus = if_else(all_of(down > up, down > 0), down, 0)
    size = ma(movav, TRUE_RANGE, period)
    return 100 * ma(movav, plus, period) / size, 100 * ma(movav, minus, period) / size


def _adx(period, movav) -> Line:
    plus, minus = _directions(period, movav)
    return 100 * ma(movav, abs(plus - minus) / (plus + minus), period)


@register("DirectionalIndicator", "DI")
def directional(period=14, movav="smma"):
    plus, minus = _directions(period, movav)
    return {"plusdi": plus, "minusdi": minus}


@register("PlusDirectionalIndicator", "PlusDI", "+DI")
def plus_di(period=14, movav="smma"):
    return {"plusdi": _directions(period, movav)[0]}


@register("MinusDirectionalIndicator", "MinusDI", "-DI")
def minus_di(period=14, movav="smma"):
    return {"minusdi": _directions(period, movav)[1]}


@register("AverageDirectionalMovementIndex", "ADX")
def adx(period=14, movav="smma"):
    return {"adx": _adx(period, movav)}


@register("AverageDirectionalMovementIndexRating", "ADXR")
def adxr(period=14, movav="smma"):
    a = _adx(period, movav)
    return {"adx": a, "adxr": (a + lag(a, period)) / 2}


@register("DirectionalMovementIndex", "DMI")
def dmi(period=14, movav="smma"):
    return adx(period, movav) | directional(period, movav)


@register("DirectionalMovement", "DM")
def dm(period=14, movav="smma"):
    return adxr(period, movav) | directional(period, movav)


def _aroon(x, period: int) -> Line:
    return (100.0 / period) * (period - (row_number() - extreme_row(period + 1, x)))


@register("AroonUp")
def aroon_up(period=14):
    return {"aroonup": _aroon(HIGH, period)}


@register("AroonDown")
def aroon_down(period=14):
    return {"aroondown": _aroon(-LOW, period)}


@register("AroonUpDown", "AroonIndicator")
def aroon(period=14):
    return aroon_up(period) | aroon_down(period)


@register("AroonOscillator", "AroonOsc")
def aroon_oscillator(period=14):
    return {"aroonosc": _aroon(HIGH, period) - _aroon(-LOW, period)}


@register("AroonUpDownOscillator", "AroonUpDownOsc")
def aroon_all(period=14):
    return aroon(period) | aroon_oscillator(period)


@register("Ichimoku")
def ichimoku(tenkan=9, kijun=26, senkou=52, senkou_lead=26, chikou=26):
    middle = lambda p: (rolling("max", p, HIGH) + rolling("min", p, LOW)) / 2
    t, k = middle(tenkan), middle(kijun)
    return {"tenkan_sen": t, "kijun_sen": k, "senkou_span_a": lag((t + k) / 2, senkou_lead), "senkou_span_b": lag(middle(senkou), senkou_lead), "chikou_span": lead(CLOSE, chikou)}


def heikin_lines() -> Lines:
    close = (OPEN + HIGH + LOW + CLOSE) / 4
    first = fold("HalfWay", (OPEN + CLOSE) / 2, close)
    return {"ha_open": first, "ha_high": max_of(HIGH, first, close), "ha_low": min_of(LOW, first, close), "ha_close": close}


@register("HeikinAshi")
def heikin_ashi():
    second = row_number() > 1
    return {k: op("CASE WHEN {0} = 1 THEN {1} END", second, v) for k, v in heikin_lines().items()}


@register("haDelta", "haD")
def ha_delta(period=3, movav="sma"):
    h = heikin_ashi()
    d = h["ha_close"] - h["ha_open"]
    return {"hadelta": d, "smoothed": ma(movav, d, period)}


@register("ParabolicSAR", "PSAR")
def psar(period=2, af=0.02, afmax=0.20):
    return {"psar": fold("StopAndReverse", HIGH, LOW, CLOSE, params=(period, af, afmax))}


def _pivot(open_: bool, close: bool) -> Line:
    return (HIGH + LOW + 2 * CLOSE) / 4 if close else (HIGH + LOW + CLOSE + OPEN) / 4 if open_ else (HIGH + LOW + CLOSE) / 3


@register("PivotPoint")
def pivot(open=False, close=False):  # noqa: A002
    p = _pivot(open, close)
    return {"p": p, "s1": 2 * p - HIGH, "s2": p - (HIGH - LOW), "r1": 2 * p - LOW, "r2": p + (HIGH - LOW)}


@register("PreviousPivotPoint", "PivotPoint1")
def previous_pivot(open=False, close=False):  # noqa: A002
    return {k: lag(v, 1) for k, v in pivot(open, close).items()}


@register("FibonacciPivotPoint")
def fibonacci_pivot(open=False, close=False, levels=(0.382, 0.618, 1.0)):  # noqa: A002
    p = _pivot(open, close)
    return {"p": p} | {f"s{k}": p - v * (HIGH - LOW) for k, v in enumerate(levels, 1)} | {f"r{k}": p + v * (HIGH - LOW) for k, v in enumerate(levels, 1)}


@register("DemarkPivotPoint")
def demark_pivot():
    x = choose_by_order(CLOSE, OPEN, HIGH + 2 * LOW + CLOSE, 2 * HIGH + LOW + CLOSE, HIGH + LOW + 2 * CLOSE)
    return {"p": x / 4, "s1": x / 2 - HIGH, "r1": x / 2 - LOW}


@register("Vortex", "contrib.Vortex")
def vortex(period=14):
    tr = rolling("sum", period, max_of(abs(HIGH - LOW), abs(HIGH - lag(CLOSE, 1)), abs(LOW - lag(CLOSE, 1))))
    return {"vi_plus": rolling("sum", period, abs(HIGH - lag(LOW, 1))) / tr, "vi_minus": rolling("sum", period, abs(LOW - lag(HIGH, 1))) / tr}


@register("Fractal")
def fractal(period=5, bardist=0.015, shift=2):
    """A bar that is the first extreme of the window that begins `shift` bars before it, moved off by `bardist`."""
    ago = row_number() - extreme_row(period, HIGH, oldest=True)
    under = row_number() - extreme_row(period, -LOW, oldest=True)
    back = period - 1 - shift
    top = if_else(ago == back, rolling("max", period, HIGH) * (1 + bardist), None)
    bottom = if_else(under == back, rolling("min", period, LOW) * (1 - bardist), None)
    return {"fractal_bearish": lead(top, back), "fractal_bullish": lead(bottom, back)}


@register("Signal", "LinePlotterIndicator")
def signal(data=None):
    return {"signal": CLOSE - sma(CLOSE, 30) if data is None else line(data)}


@register("SMACloseSignal")
def sma_close_signal(period=30):
    return {"signal": CLOSE - sma(CLOSE, period)}


@register("SMAExitSignal")
def sma_exit_signal(p1=5, p2=30):
    return {"signal": sma(CLOSE, p1) - sma(CLOSE, p2)}


@register("SMACrossOver")
def sma_cross_over(p1=10, p2=30):
    return {"signal": crossing(sma(CLOSE, p1), sma(CLOSE, p2))}


@register("RelativeVolume")
def relative_volume(period=20, volisnan=False):
    """Volume `period` bars ago by today's; without volume 0, or null where missing volume is null already."""
    v = lag(VOLUME, period)
    return {"relvol": v / VOLUME if volisnan else div_by_zero(v, VOLUME)}
