"""Path-dependent outcomes of entries, and two-legged strategies: state machines over ordered rows.

Both read sorted partitions once. What is kept for a symbol are the entries that are still open, or one pair position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.plans.ordered import in_order


@dataclass
class _Entry:
    dt: object
    price: float
    stop: float
    bar: int
    left: float = 1.0
    pnl: float = 0.0
    hits: int = 0
    qualified: int | None = None
    best: float = 0.0


def multi_take_profit(bars: DataFrame, entries: str, takes: tuple[float, ...] = (0.01, 0.02, 0.03), weights: tuple[float, ...] = (0.5, 0.3, 0.2), stop: float = 0.01, hold: int | None = None, slippage: float = 0.0, trail: float | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every bar where the column `entries` holds buys at its close; what becomes of it: keys, dt, pnl, outcome (1, 0, -1), exit, bars, take_hits, bars_to_take.

    Of each later bar the low is held against the stop before the high against the takes, so a bar with both is a loss.
    A take closes its weight. After the first one the stop follows the highest high at a distance of `trail` (a share of the price).
    An entry ends when nothing is left, after `hold` bars, or with the data, at the close then. Returns are shares of the entry price.
    """
    keys = tuple(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_, n, now = None, [], 0, None
        out: list[dict] = []

        def end(e: _Entry, price: float, dt) -> None:
            e.pnl += e.left * (price * (1 - slippage) / e.price - 1)
            outcome = 1 if e.pnl > 0 else -1 if e.pnl < 0 else 0
            out.append(dict(zip(keys, last, strict=True)) | {"dt": e.dt, "pnl": e.pnl, "outcome": outcome, "exit": dt, "bars": n - e.bar, "take_hits": e.hits, "bars_to_take": e.qualified})

        def step(e: _Entry, low: float, high: float) -> bool:
            if low <= e.stop:
                end(e, e.stop, now)
                return True
            while e.hits < len(takes) and high >= e.price * (1 + takes[e.hits]):
                share = min(weights[e.hits], e.left)
                e.pnl += share * (takes[e.hits] - slippage)
                e.left -= share
                e.hits += 1
                e.qualified = e.qualified or n - e.bar
            if e.left <= 1e-12:
                e.left = 0.0
                end(e, e.price, now)
                return True
            e.best = max(e.best, high)
            if trail is not None and e.hits:
                e.stop = max(e.stop, e.best * (1 - trail))
            return False

        schema, close = None, None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(k) for k in keys] + [("dt", pa.timestamp("us")), ("pnl", pa.float64()), ("outcome", pa.int64()), ("exit", pa.timestamp("us")), ("bars", pa.int64()), ("take_hits", pa.int64()), ("bars_to_take", pa.int64())])
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != last:
                    for e in open_:
                        end(e, close, now)
                    last, open_, n = key, [], 0
                n, now, close = n + 1, r["dt"], r["close"]
                open_ = [e for e in open_ if not step(e, r["low"], r["high"])]
                if hold is not None:
                    for e in [e for e in open_ if n - e.bar >= hold]:
                        end(e, close, now)
                        open_.remove(e)
                if r[entries]:
                    price = close * (1 + slippage)
                    open_.append(_Entry(now, price, price * (1 - stop), n, best=price))
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
        for e in open_:
            end(e, close, now)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    fields = T.StructType([bars.schema[k] for k in keys] + T.DataType.fromDDL("dt timestamp_ntz, pnl double, outcome long, exit timestamp_ntz, bars long, take_hits long, bars_to_take long").fields)
    own = bars.select(*keys, "dt", "high", "low", "close", F.coalesce(F.col(entries).cast("boolean"), F.lit(False)).alias(entries))
    return in_order(own, keys, "dt").mapInArrow(run, fields)


def pair_trading(pairs: DataFrame, upper: float = 2.1, lower: float = -2.1, up_medium: float = 0.5, low_medium: float = -0.5, cash: float = 10_000.0, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Trades the z-score of two series (columns y, x, zscore): above `upper` the first is sold and the second bought, below
    `lower` the other way round, each for half of the account's value; between the mediums both legs are closed.
    keys, dt, status (-1 short, 0 flat, 1 long), size_y, size_x, value: decisions at a row's values, filled at them.
    """
    keys = tuple(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, money, a, b, status = None, cash, 0.0, 0.0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != last:
                    last, money, a, b, status = key, cash, 0.0, 0.0, 0
                y, x, z = r["y"], r["x"], r["zscore"]
                value = money + a * y + b * x
                want = status if z is None else -1 if z > upper and status != -1 else 1 if z < lower and status != 1 else 0 if status and low_medium < z < up_medium else status
                if want != status:
                    status = want
                    na, nb = status * (value / 2 // y), -status * (value / 2 // x)
                    money, a, b = value - na * y - nb * x, na, nb
                out.append(dict(zip(keys, key, strict=True)) | {"dt": r["dt"], "status": status, "size_y": a, "size_x": b, "value": value})
            schema = pa.schema([batch.schema.field(k) for k in keys] + [("dt", pa.timestamp("us")), ("status", pa.int64()), ("size_y", pa.float64()), ("size_x", pa.float64()), ("value", pa.float64())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    fields = T.StructType([pairs.schema[k] for k in keys] + T.DataType.fromDDL("dt timestamp_ntz, status long, size_y double, size_x double, value double").fields)
    return in_order(pairs.select(*keys, "dt", "y", "x", "zscore"), keys, "dt").mapInArrow(run, fields)
