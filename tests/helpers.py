"""Bars made of a simple walk, and results as plain rows."""

import datetime as dt
import random

BARS = "symbol string, dt timestamp_ntz, open double, high double, low double, close double, volume double, openinterest double"


def walk(n, symbol="A", seed=1, step=dt.timedelta(days=1), start=dt.datetime(2024, 1, 1)):
    r, price, out = random.Random(seed), 100.0, []
    for k in range(n):
        o = price
        price = max(5.0, price + r.uniform(-3, 3))
        out.append((symbol, start + k * step, o, max(o, price) + r.random(), min(o, price) - r.random(), price, float(r.randint(1, 9)), 0.0))
    return out


def column(df, name, symbol="A"):
    return [r[name] for r in df.where(f"symbol = '{symbol}'").orderBy("dt").collect()]


def close_to(a, b, tol=1e-9):
    return len(a) == len(b) and all((x is None and y is None) or (x is not None and y is not None and abs(x - y) <= tol * max(1, abs(y))) for x, y in zip(a, b, strict=True))
