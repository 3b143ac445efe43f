"""Ordered folds: values that depend on their own previous output, which no window function can express.

A fold is a class with `step(*values) -> value`, made anew for every symbol. Those that are linear also have
`many(arrays, valid) -> array`, the same for a run of rows at once, NaN for null. `SQL` gives the same recurrence as states of
a recursive query: name -> (first row, later rows); in it x0, x1 ... are the inputs, p0, p1 ... the parameters and r.<name>
the previous state; the last state is the output, null where `SKIP` holds.
"""

from __future__ import annotations

import numpy as np


def smoothed(x: np.ndarray, alpha: float, before: float) -> np.ndarray:
    """Exponential smoothing of values that follow `before`."""
    import pandas as pd

    return pd.Series(np.concatenate(([before], x))).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


class Ema:
    """Exponential smoothing, seeded with the mean of the first `period` values; nulls are passed over."""

    SKIP = "x0 IS NULL"
    SQL = {
        "n": ("CASE WHEN x0 IS NULL THEN 0 ELSE 1 END", "r.n + CASE WHEN x0 IS NULL THEN 0 ELSE 1 END"),
        "total": ("coalesce(x0, 0::DOUBLE)", "CASE WHEN r.n < p0 THEN r.total + coalesce(x0, 0::DOUBLE) ELSE r.total END"),
        "v": ("CASE WHEN p0 = 1 THEN x0 END", "CASE WHEN x0 IS NULL THEN r.v WHEN r.n + 1 < p0 THEN NULL WHEN r.n + 1 = p0 THEN (r.total + x0) / p0 ELSE r.v * (1 - p1::DOUBLE) + x0 * p1::DOUBLE END"),
    }

    def __init__(self, period: int, alpha: float):
        self.period, self.alpha, self.n, self.total, self.v = period, alpha, 0, 0.0, None

    def step(self, x):
        if x is None:
            return None
        self.n += 1
        if self.n <= self.period:
            self.total += x
            if self.n == self.period:
                self.v = self.total / self.period
        else:
            self.v = self.v * (1 - self.alpha) + x * self.alpha
        return self.v

    def many(self, arrays: list[np.ndarray], valid: np.ndarray) -> np.ndarray:
        out, x = np.full(len(valid), np.nan), arrays[0][valid]
        early = min(max(self.period - self.n, 0), len(x))
        values = [self.step(v) for v in x[:early].tolist()]
        if early < len(x):
            rest = smoothed(x[early:], self.alpha, self.v)
            self.n, self.v = self.n + len(rest), float(rest[-1])
            values = np.concatenate((np.array(values, float), rest))
        out[valid] = values
        return out


class DynamicEma:
    """Smoothing by a factor of its own for every row (x1); it starts where the factor and the seed (x2) first exist."""

    SKIP = "x1 IS NULL OR x0 IS NULL"
    SQL = {"v": ("CASE WHEN x1 IS NOT NULL THEN x2 END", "CASE WHEN x1 IS NULL OR x0 IS NULL THEN r.v WHEN r.v IS NULL THEN x2 ELSE r.v * (1 - x1) + x0 * x1 END")}

    def __init__(self):
        self.v = None

    def step(self, x, alpha, seed):
        if x is None or alpha is None:
            return None
        self.v = seed if self.v is None else self.v * (1 - alpha) + x * alpha
        return self.v


class FirstEma:
    """Exponential smoothing that starts from the first value."""

    SKIP = "x0 IS NULL"
    SQL = {"v": ("x0", "CASE WHEN x0 IS NULL THEN r.v WHEN r.v IS NULL THEN x0 ELSE r.v * (1 - p0::DOUBLE) + x0 * p0::DOUBLE END")}

    def __init__(self, alpha: float):
        self.alpha, self.v = alpha, None

    def step(self, x):
        if x is None:
            return None
        self.v = x if self.v is None else self.v * (1 - self.alpha) + x * self.alpha
        return self.v

    def many(self, arrays: list[np.ndarray], valid: np.ndarray) -> np.ndarray:
        out, x = np.full(len(valid), np.nan), arrays[0][valid]
        if len(x):
            values = smoothed(x, self.alpha, x[0] if self.v is None else self.v)
            self.v = float(values[-1])
            out[valid] = values
        return out


class Laguerre:
    """Stage `stage` (0-3) of the four-stage filter; stages are 0 before row `start` (from 1)."""

    SKIP = "r.n < p1"
    _G = "(p0::DOUBLE)"
    SQL = {
        "n": ("1", "r.n + 1"),
        "a": (f"CASE WHEN p1 <= 1 THEN (1 - {_G}) * x0 ELSE 0::DOUBLE END", f"CASE WHEN r.n + 1 >= p1 THEN (1 - {_G}) * x0 + {_G} * r.a ELSE 0::DOUBLE END"),
        "b": (f"CASE WHEN p1 <= 1 THEN -{_G} * ((1 - {_G}) * x0) ELSE 0::DOUBLE END", f"CASE WHEN r.n + 1 >= p1 THEN -{_G} * ((1 - {_G}) * x0 + {_G} * r.a) + r.a + {_G} * r.b ELSE 0::DOUBLE END"),
        "c": (f"CASE WHEN p1 <= 1 THEN {_G} * {_G} * ((1 - {_G}) * x0) ELSE 0::DOUBLE END", f"CASE WHEN r.n + 1 >= p1 THEN -{_G} * (-{_G} * ((1 - {_G}) * x0 + {_G} * r.a) + r.a + {_G} * r.b) + r.b + {_G} * r.c ELSE 0::DOUBLE END"),
        "d": (f"CASE WHEN p1 <= 1 THEN -{_G} * ({_G} * {_G} * ((1 - {_G}) * x0)) ELSE 0::DOUBLE END", f"CASE WHEN r.n + 1 >= p1 THEN -{_G} * (-{_G} * (-{_G} * ((1 - {_G}) * x0 + {_G} * r.a) + r.a + {_G} * r.b) + r.b + {_G} * r.c) + r.c + {_G} * r.d ELSE 0::DOUBLE END"),
    }
    OUT = "CASE WHEN n < p1 THEN NULL WHEN p2 = 0 THEN a WHEN p2 = 1 THEN b WHEN p2 = 2 THEN c ELSE d END"

    def __init__(self, gamma: float, start: int, stage: int):
        self.g, self.start, self.stage, self.n, self.s = gamma, start, stage, 0, [0.0] * 4

    def step(self, x):
        self.n += 1
        if self.n < self.start or x is None:
            return None
        g, old = self.g, self.s
        new = [(1 - g) * x + g * old[0]]
        for k in (1, 2, 3):
            new.append(-g * new[k - 1] + old[k - 1] + g * old[k])
        self.s = new
        return new[self.stage]


class HalfWay:
    """Each value lies half-way between the last one and the last x1; the first is x0 (the open of averaged bars)."""

    SKIP = "FALSE"
    SQL = {"c": ("x1", "x1"), "v": ("x0", "(r.v + r.c) / 2")}

    def __init__(self):
        self.v = None

    def step(self, first, x):
        self.v, self.last = (first if self.v is None else (self.v + self.last) / 2), x
        return self.v


class LeastErrorGain:
    """An average that is corrected by the gain, of -limit/10 to limit/10 in tenths, that brings it closest to the price."""

    SKIP = "x0 IS NULL OR x1 IS NULL"
    _V = "(p0::DOUBLE * x1 + (1 - p0::DOUBLE) * r.v) + g * (p0::DOUBLE * (x0 - r.v) / 10)"
    SQL = {
        "v": (
            "CASE WHEN x0 IS NOT NULL THEN x1 END",
            f"CASE WHEN x0 IS NULL OR x1 IS NULL THEN r.v WHEN r.v IS NULL THEN x1 ELSE list_sort(list_transform(range(-p1, p1 + 1), lambda g: {{'far': abs(x0 - ({_V})), 'gain': g, 'v': {_V}}}))[1].v END",
        )
    }

    def __init__(self, alpha: float, limit: int):
        self.alpha, self.limit, self.v = alpha, limit, None

    def step(self, price, average):
        if average is None or price is None:
            return None
        if self.v is None:
            self.v = average
            return self.v
        flat = self.alpha * average + (1 - self.alpha) * self.v
        slope = self.alpha * (price - self.v) / 10
        self.v = min((flat + g * slope for g in range(-self.limit, self.limit + 1)), key=lambda v: abs(price - v))
        return self.v


class StopAndReverse:
    """Parabolic stop-and-reverse of (high, low, close); shown from row `period`."""

    SKIP = "FALSE"

    # State before the row (up, stop, extreme, speed), after a reversal, and after the row, each written over the one before.
    _UP = "(CASE WHEN r.n = 1 THEN (CASE WHEN x2 >= r.lc THEN 0 ELSE 1 END) ELSE r.up END)"
    _STOP = "(CASE WHEN r.n = 1 THEN (x0 + x1) / 2 ELSE r.stop END)"
    _FAR = "(CASE WHEN r.n = 1 THEN (CASE WHEN x2 >= r.lc THEN r.ll ELSE r.lh END) ELSE r.far END)"
    _SPEED = "(CASE WHEN r.n = 1 THEN p1 ELSE r.speed END)"
    _TURNS = f"(({_UP} = 1 AND {_STOP} >= x1) OR ({_UP} = 0 AND {_STOP} <= x0))"
    _UP1 = f"(CASE WHEN {_TURNS} THEN 1 - {_UP} ELSE {_UP} END)"
    _STOP1 = f"(CASE WHEN {_TURNS} THEN {_FAR} ELSE {_STOP} END)"
    _FAR1 = f"(CASE WHEN NOT {_TURNS} THEN {_FAR} WHEN {_UP1} = 1 THEN x0 ELSE x1 END)"
    _SPEED1 = f"(CASE WHEN {_TURNS} THEN p1 ELSE {_SPEED} END)"
    _BEYOND = f"(({_UP1} = 1 AND x0 > {_FAR1}) OR ({_UP1} = 0 AND x1 < {_FAR1}))"
    _FAR2 = f"(CASE WHEN NOT {_BEYOND} THEN {_FAR1} WHEN {_UP1} = 1 THEN x0 ELSE x1 END)"
    _SPEED2 = f"(CASE WHEN {_BEYOND} THEN least({_SPEED1} + p1, p2) ELSE {_SPEED1} END)"
    _STOP2 = f"({_STOP1} + {_SPEED2} * ({_FAR2} - {_STOP1}))"
    SQL = {
        "n": ("1", "r.n + 1"), "lh": ("x0", "x0"), "ll": ("x1", "x1"), "lc": ("x2", "x2"), "up": ("NULL", _UP1), "far": ("NULL", _FAR2), "speed": ("NULL", _SPEED2),
        "stop": ("NULL", f"CASE WHEN {_UP1} = 1 THEN least({_STOP2}, x1, r.ll) ELSE greatest({_STOP2}, x0, r.lh) END"), "shown": ("NULL", _STOP1),
    }
    OUT = "CASE WHEN n >= p0 THEN shown END"

    def __init__(self, period: int, step_: float, most: float):
        self.period, self.by, self.most, self.n, self.state, self.last = period, step_, most, 0, None, None

    def step(self, high, low, close):
        self.n += 1
        before, self.last = self.last, (high, low, close)
        if before is None:
            return None
        if self.state is None:  # a made-up trend that the first real row reverses
            rising = close >= before[2]
            self.state = (not rising, (high + low) / 2, before[1] if rising else before[0], self.by)
        rising, stop, extreme, speed = self.state
        if (rising and stop >= low) or (not rising and stop <= high):
            rising, stop, speed = not rising, extreme, self.by
            extreme = high if rising else low
        shown = stop
        if (rising and high > extreme) or (not rising and low < extreme):
            extreme, speed = (high if rising else low), min(speed + self.by, self.most)
        stop += speed * (extreme - stop)
        stop = min(stop, low, before[1]) if rising else max(stop, high, before[0])
        self.state = (rising, stop, extreme, speed)
        return shown if self.n >= self.period else None


FOLDS = {c.__name__: c for c in (Ema, DynamicEma, FirstEma, Laguerre, HalfWay, LeastErrorGain, StopAndReverse)}
