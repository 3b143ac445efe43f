"""Kinds of orders, slippage and signals against SQL: an order is made on a bar of a known number, and SQL looks for the first
bar after it that fills it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import broker as B
from barloom.operators.indicators import CLOSE, sma
from barloom.plans.lines import to_sql, with_lines
from barloom.queries_accounts import _B, RICH, ByNumber, _named, _variants
from barloom.sources.views import ORDERS_SQL, bars_orders

_KEYS = ("symbol", "param_id")

# name: (side, kind, stop or limit price by the close, limit by the close)
KINDS = {
    "limit_buy": (B.BUY, B.LIMIT, 0.9, None), "limit_sell": (B.SELL, B.LIMIT, 1.1, None), "stop_buy": (B.BUY, B.STOP, 1.1, None), "stop_sell": (B.SELL, B.STOP, 0.9, None),
    "stop_limit_buy": (B.BUY, B.STOP_LIMIT, 1.1, 1.2), "stop_limit_sell": (B.SELL, B.STOP_LIMIT, 0.9, 0.8), "close_buy": (B.BUY, B.CLOSE, None, None),
}
TRAILS = {"trail_buy": B.BUY, "trail_sell": B.SELL}


def _end(b: B.Broker, bar: dict) -> None:
    for o in list(b.pending):
        b.cancel(o)
    b.close()


def _cycle(make) -> ByNumber:
    """An order after bar 1 of every twenty; after bar 18 what waits is cancelled and the position closed."""
    return ByNumber(20, n1=make, n18=_end)


#: Orders of `_cycle` (made, sig) and the bars that may fill them.
_O = f"""{_B}, o AS (SELECT symbol, rn AS made, dt AS created, close AS sig FROM b WHERE rn % 20 = 1),
x AS MATERIALIZED (SELECT o.*, b.rn, b.dt, b.open, b.high, b.low, b.close, max(b.close) OVER w AS top, min(b.close) OVER w AS bottom FROM o JOIN b ON b.symbol = o.symbol AND b.rn > o.made AND b.rn < o.made + 18 WINDOW w AS (PARTITION BY o.symbol, o.made ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _limit(side: int, want: str) -> str:
    """The price at which a bar fills a limit order, or null."""
    return f"CASE WHEN open <= {want} THEN open WHEN low <= {want} THEN {want} END" if side == B.BUY else f"CASE WHEN open >= {want} THEN open WHEN high >= {want} THEN {want} END"


def _stop(side: int, want: str) -> str:
    return f"CASE WHEN open >= {want} THEN open WHEN high >= {want} THEN {want} END" if side == B.BUY else f"CASE WHEN open <= {want} THEN open WHEN low <= {want} THEN {want} END"


def _kind_sql(name: str, side: int, kind: str, price: float | None, limit: float | None) -> str:
    want, bound = f"(sig * {price}::DOUBLE)", f"(sig * {limit}::DOUBLE)"
    if kind == B.STOP_LIMIT:
        reached = f"(open >= {want} OR high >= {want})" if side == B.BUY else f"(open <= {want} OR low <= {want})"
        at_open = f"open >= {want}" if side == B.BUY else f"open <= {want}"
        first = f"SELECT *, min(CASE WHEN {reached} THEN rn END) OVER (PARTITION BY symbol, made) AS hit FROM x"
        fill = f"CASE WHEN rn > hit OR {at_open} THEN {_limit(side, bound)} ELSE {want} END"
        source = f"(SELECT *, {fill} AS price FROM ({first}) WHERE rn >= hit)"
    else:
        fill = "close" if kind == B.CLOSE else _limit(side, want) if kind == B.LIMIT else _stop(side, want)
        source = f"(SELECT *, {fill} AS price FROM x)"
    return f"SELECT '{name}' AS name, symbol, created, min(dt) AS dt, {side}::DOUBLE AS size, round(arg_min(price, rn), 6) AS price FROM {source} WHERE price IS NOT NULL GROUP BY symbol, made, created"


def q_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(first: dict) -> ByNumber:
        side, kind, price, limit = KINDS[first["variant"]]
        return _cycle(lambda b, bar: b.order(side, 1, kind, bar["close"] * price if price else None, bar["close"] * limit if limit else None))

    ev = B.simulate(bars_orders(spark, sf_dir), make, lambda first: B.Broker(cash=RICH), variants=_variants(KINDS))
    return _entries(ev, list(KINDS))


def _entries(ev: DataFrame, names: list[str]) -> DataFrame:
    """Orders that were filled, but for those that close positions (market orders)."""
    done = B.orders(ev, _KEYS).where("status = 'Completed' AND type <> 'Market'")
    return _named(done, names).select("name", "symbol", "created", F.col("executed").alias("dt"), (F.col("side") * F.col("size")).alias("size"), F.round("price", 6).alias("price"))


_KINDS_SQL = f"WITH {_O} " + " UNION ALL ".join(_kind_sql(n, *spec) for n, spec in KINDS.items())


def q_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops that follow the close at a tenth of it."""
    make = lambda first: _cycle(lambda b, bar: b.order(TRAILS[first["variant"]], 1, B.STOP_TRAIL, trail_percent=0.1))
    return _entries(B.simulate(bars_orders(spark, sf_dir), make, lambda first: B.Broker(cash=RICH), variants=_variants(TRAILS)), list(TRAILS))


def _trail_sql(name: str, side: int) -> str:
    near = f"{'least' if side == B.BUY else 'greatest'}(sig, coalesce({'bottom' if side == B.BUY else 'top'}, sig))"
    stop = f"({near} + {side} * ({near} * 0.1::DOUBLE))"
    return f"SELECT '{name}' AS name, symbol, created, min(dt) AS dt, {side}::DOUBLE AS size, round(arg_min(price, rn), 6) AS price FROM (SELECT *, {_stop(side, stop)} AS price FROM x) WHERE price IS NOT NULL GROUP BY symbol, made, created"


_TRAILS_SQL = f"WITH {_O} " + " UNION ALL ".join(_trail_sql(n, side) for n, side in TRAILS.items())


def q_one_cancels_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit below and a stop above: what becomes of both."""

    def both(b: B.Broker, bar: dict) -> None:
        low = b.buy(1, kind=B.LIMIT, price=bar["close"] * 0.9)
        b.buy(1, kind=B.STOP, price=bar["close"] * 1.1, oco=low)

    ev = B.simulate(bars_orders(spark, sf_dir), lambda first: _cycle(both), lambda first: B.Broker(cash=RICH))
    return B.orders(ev).where("type <> 'Market' AND status IN ('Completed', 'Canceled')").select("symbol", "created", "type", "status", F.col("executed").alias("dt"))


_OCO_SQL = f"""WITH {_O}, f AS (SELECT symbol, made, rn, dt, {_limit(B.BUY, '(sig * 0.9::DOUBLE)')} IS NOT NULL AS low, {_stop(B.BUY, '(sig * 1.1::DOUBLE)')} IS NOT NULL AS up FROM x),
g AS (SELECT symbol, made, min(dt) AS dt, arg_min(low, rn) AS low FROM f WHERE low OR up GROUP BY symbol, made), n AS (SELECT symbol, max(rn) AS n FROM b GROUP BY symbol)
SELECT o.symbol, o.created, k.type, CASE WHEN g.dt IS NOT NULL AND g.low = (k.type = 'Limit') THEN 'Completed' ELSE 'Canceled' END AS status, CASE WHEN g.low = (k.type = 'Limit') THEN g.dt END AS dt
FROM o JOIN n USING (symbol) CROSS JOIN (VALUES ('Limit'), ('Stop')) k(type) LEFT JOIN g ON g.symbol = o.symbol AND g.made = o.made WHERE g.dt IS NOT NULL OR n.n >= o.made + 17"""


def q_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits that are good for ten days: filled, expired, or still waiting at the end of the series or of their turn."""
    make = lambda first: _cycle(lambda b, bar: b.buy(1, kind=B.LIMIT, price=bar["close"] * 0.6, valid=timedelta(days=10)))
    ev = B.simulate(bars_orders(spark, sf_dir), make, lambda first: B.Broker(cash=RICH))
    return B.orders(ev).where("type = 'Limit' AND status IN ('Completed', 'Expired')").select("symbol", "created", "status", F.col("executed").alias("dt"))


_EXPIRY_SQL = f"""WITH {_O}, f AS (SELECT symbol, made, created, rn, dt, dt > created + INTERVAL 10 DAY AS late, {_limit(B.BUY, '(sig * 0.6::DOUBLE)')} IS NOT NULL AS hit FROM x)
SELECT symbol, created, CASE WHEN arg_min(late, rn) THEN 'Expired' ELSE 'Completed' END AS status, CASE WHEN NOT arg_min(late, rn) THEN min(dt) END AS dt FROM f WHERE late OR hit GROUP BY symbol, made, created"""


def q_buy_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long at the open after bar 3 of every 60, with a stop below and a take above that end one another."""
    make = lambda first: ByNumber(60, n3=lambda b, bar: b.bracket(B.BUY, 1, None, bar["close"] * 0.7, bar["close"] * 1.3))
    ev = B.simulate(bars_orders(spark, sf_dir), make, lambda first: B.Broker(cash=RICH))
    return B.trades(ev).where("barlen < 50").select("symbol", "dtopen", "dtclose", "long", F.round("pnl", 4).alias("pnl"))


_BUY_BRACKET_SQL = f"""WITH {_B}, o AS (SELECT s.symbol, e.rn, e.dt, e.open, s.close AS sig FROM b s JOIN b e ON e.symbol = s.symbol AND e.rn = s.rn + 1 WHERE s.rn % 60 = 3),
x AS (SELECT o.symbol, o.dt AS dtopen, o.open, x.rn - o.rn AS later, x.dt, CASE WHEN x.open <= sig * 0.7::DOUBLE THEN x.open WHEN x.low <= sig * 0.7::DOUBLE THEN sig * 0.7::DOUBLE WHEN x.open >= sig * 1.3::DOUBLE THEN x.open ELSE sig * 1.3::DOUBLE END AS price FROM o JOIN b x ON x.symbol = o.symbol AND x.rn > o.rn AND x.rn < o.rn + 50 AND (x.low <= sig * 0.7::DOUBLE OR x.high >= sig * 1.3::DOUBLE))
SELECT symbol, dtopen, min(dt) AS dtclose, TRUE AS long, round(arg_min(price, later) - any_value(open), 4) AS pnl FROM x GROUP BY symbol, dtopen"""

SLIPPAGES = {"none": B.Slippage(percent=0.05), "percent": B.Slippage(percent=0.05, at_open=True), "fixed": B.Slippage(fixed=700.0, at_open=True), "outside": B.Slippage(percent=0.05, at_open=True, outside=True)}


def q_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and sales at the open, moved against the order, but not beyond the bar unless that is allowed."""
    make = lambda first: ByNumber(10, n3=lambda b, bar: b.buy(1), n8=lambda b, bar: b.close())
    ev = B.simulate(bars_orders(spark, sf_dir), make, lambda first: B.Broker(cash=RICH, slippage=SLIPPAGES[first["variant"]]), variants=_variants(SLIPPAGES))
    return _named(B.executions(ev, _KEYS), list(SLIPPAGES)).select("name", "symbol", "dt", "size", F.round("price", 6).alias("price"))


_MOVED = "CASE name WHEN 'fixed' THEN e.open + side * 700 ELSE e.open * (1 + side * 0.05::DOUBLE) END"
_SLIPPAGE_SQL = f"""WITH {_B}, n AS (SELECT unnest({list(SLIPPAGES)!r}) AS name), z AS (SELECT name, s.symbol, e.dt, side, e.open, CASE WHEN side > 0 THEN e.high ELSE e.low END AS far, {_MOVED} AS moved FROM n, (SELECT *, CASE WHEN rn % 10 = 3 THEN 1 ELSE -1 END AS side FROM b) s JOIN b e ON e.symbol = s.symbol AND e.rn = s.rn + 1 WHERE s.rn % 10 IN (3, 8))
SELECT name, symbol, dt, side::DOUBLE AS size, round(CASE WHEN name = 'none' THEN open WHEN (far - moved) * side >= 0 OR name = 'outside' THEN moved ELSE far END, 6) AS price FROM z"""

SIGNALS = {"longshort": {"longshort": "s"}, "long": {"long": "s"}, "short": {"short": "s"}, "long_inv": {"long_inv": "s"}, "long_exit": {"long": "s", "longexit": "s"}, "short_exit": {"short": "s", "shortexit": "s"}}


def q_signal_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of each kind of signal, made of the same line."""
    b = with_lines(bars_orders(spark, sf_dir), {"s": CLOSE - sma(CLOSE, 10)})
    ev = B.simulate(b, lambda first: B.SignalStrategy(SIGNALS[first["variant"]]), lambda first: B.Broker(cash=RICH), variants=_variants(SIGNALS))
    return _named(B.trades(ev, _KEYS), list(SIGNALS)).select("name", "symbol", "long", "dtopen", "dtclose", F.round("pnl", 4).alias("pnl"))


_SIGNAL_LINE = to_sql(ORDERS_SQL, {"s": CLOSE - sma(CLOSE, 10)}, "symbol, dt, open, s")
_SIGNALS_SQL = f"""WITH n AS (SELECT unnest({list(SIGNALS)!r}) AS name), d AS MATERIALIZED (SELECT *, lag(s) OVER (PARTITION BY symbol ORDER BY dt) AS due FROM ({_SIGNAL_LINE})),
m AS MATERIALIZED (SELECT name, symbol, dt, open, coalesce(last_value(CASE WHEN due IS NULL OR due = 0 THEN NULL WHEN name = 'longshort' THEN sign(due) WHEN name IN ('long', 'long_exit') THEN (due > 0)::INT WHEN name = 'long_inv' THEN (due < 0)::INT ELSE -(due < 0)::INT END IGNORE NULLS) OVER (PARTITION BY name, symbol ORDER BY dt ROWS UNBOUNDED PRECEDING), 0) AS held FROM n, d),
h AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY name, symbol ORDER BY dt), 0) AS before FROM m),
c AS (SELECT *, lead(dt) OVER w AS dtclose, lead(open) OVER w AS leave FROM h WHERE held <> before WINDOW w AS (PARTITION BY name, symbol ORDER BY dt))
SELECT name, symbol, held > 0 AS long, dt AS dtopen, dtclose, round(held * (leave - open), 4) AS pnl FROM c WHERE held <> 0 AND dtclose IS NOT NULL"""


def order_queries() -> dict:
    return {
        "sim_order_kinds": (q_kinds, _KINDS_SQL), "sim_trailing_stops": (q_trails, _TRAILS_SQL), "sim_one_cancels_other": (q_one_cancels_other, _OCO_SQL), "sim_order_expiry": (q_expiry, _EXPIRY_SQL),
        "sim_buy_bracket": (q_buy_bracket, _BUY_BRACKET_SQL), "sim_slippage": (q_slippage, _SLIPPAGE_SQL), "sim_signal_kinds": (q_signal_kinds, _SIGNALS_SQL),
    }
