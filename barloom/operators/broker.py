"""Strategy simulation: orders, fills, cash, positions, trades and equity, bar by bar for every run.

A run is a key (symbol and parameter set, or an account of several symbols that share its cash). Its bars come in order
through sorted partitions, and what is kept is the account's state, never the series; runs are independent and go in
parallel. A strategy is a Python class with `next(broker, bar)`; indicators are columns that lines have added to the bars
before. One pass gives one table of events, which `orders`, `trades` and `equity` split.

Within a bar: `next_open` if the broker cheats on the open, orders handed in on the bar before (accepted or refused in
turn, as if each had been filled at the price it was made at), interest, historical orders, pending orders in the order
they were made, futures' daily settlement, then the strategy. An order made on one bar can be filled on the next at the
earliest, unless the broker cheats.

Besides `next`, a strategy may have: `prenext` (called instead while a column named in its `needs` is null), `nextstart`
(instead of the first `next`), `next_open`, `notify_order`, `notify_trade`, `notify_cashvalue`, `notify_fund`, `notify_timer`
(for every boolean column named in its `timers` that is true), `start` and `stop`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.ordered import in_order

BUY, SELL = 1, -1
MARKET, CLOSE, LIMIT, STOP, STOP_LIMIT, STOP_TRAIL, STOP_TRAIL_LIMIT, HISTORICAL = "Market", "Close", "Limit", "Stop", "StopLimit", "StopTrail", "StopTrailLimit", "Historical"


@dataclass(frozen=True)
class Commission:
    """commission: a share of the value (percent=True) or an amount per unit. margin: futures, settled daily; None: stock-like."""

    commission: float = 0.0
    mult: float = 1.0
    margin: float | None = None
    percent: bool | None = None
    leverage: float = 1.0
    interest: float = 0.0
    interest_long: bool = False
    automargin: float = 0.0

    @property
    def stock(self) -> bool:
        return self.margin is None and not self.automargin

    def fee(self, size: float, price: float) -> float:
        by_value = self.percent if self.percent is not None else self.stock
        return abs(size) * self.commission * (price if by_value else 1.0)

    def margin_of(self, price: float) -> float:
        return self.automargin * price if self.automargin else self.margin or 0.0

    def cost(self, size: float, price: float) -> float:
        """Cash that opening needs before fees; less than nothing for stocks sold short, which bring it."""
        return size * price / self.leverage if self.stock else abs(size) * self.margin_of(price)

    def value(self, size: float, price: float) -> float:
        """What a position adds to the account's value."""
        return size * price if self.stock else abs(size) * self.margin_of(price)

    def profit(self, size: float, price: float, new: float) -> float:
        return size * (new - price) * self.mult

    def settlement(self, size: float, price: float, new: float) -> float:
        return 0.0 if self.stock else self.profit(size, price, new)

    def affordable(self, cash: float, price: float) -> int:
        return int(self.leverage * (cash // (price if self.stock else self.margin_of(price))))

    def credit(self, size: float, price: float, days: int) -> float:
        if not self.interest or (size > 0 and not self.interest_long):
            return 0.0
        return days * abs(size) * price * self.interest / 365.0


STOCKS, FUTURES = Commission(percent=True), Commission(margin=1.0, percent=False)


@dataclass
class Position:
    size: float = 0.0
    price: float = 0.0

    def update(self, size: float, price: float) -> tuple[float, float]:
        """(opened, closed): the average price moves when the position grows, stays when it shrinks, is new when it turns."""
        before, after = self.size, self.size + size
        if before * size >= 0:
            opened, closed = size, 0.0
            self.price = price if not before else (self.price * before + price * size) / after if after else 0.0
        elif before * after >= 0:
            opened, closed = 0.0, size
            self.price = self.price if after else 0.0
        else:
            opened, closed = after, -before
            self.price = price
        self.size = after
        return opened, closed


@dataclass
class Trade:
    ref: int
    size: float = 0.0
    price: float = 0.0
    pnl: float = 0.0
    commission: float = 0.0
    long: bool = True
    dtopen: datetime | None = None
    dtclose: datetime | None = None
    baropen: int = 0
    barclose: int = 0
    tradeid: int = 0
    symbol: str | None = None
    history: list[dict] | None = None

    @property
    def pnlcomm(self) -> float:
        return self.pnl - self.commission

    def update(self, size: float, price: float, commission: float, pnl: float, dt, bar: int) -> None:
        if not self.size and self.dtopen is None:
            self.long, self.dtopen, self.baropen = size > 0, dt, bar
        after = self.size + size
        if self.size * size >= 0:
            self.price = (self.price * self.size + price * size) / after if after else self.price
        self.size, self.pnl, self.commission = after, self.pnl + pnl, self.commission + commission
        if not after:
            self.dtclose, self.barclose = dt, bar
        if self.history is not None:
            self.history.append({"status": "Closed" if self.dtclose else "Open", "dt": dt, "size": self.size, "price": self.price, "pnl": self.pnl, "pnlcomm": self.pnlcomm, "barlen": bar - self.baropen})


@dataclass
class Book:
    """What an account knows of one symbol."""

    position: Position = field(default_factory=Position)
    trade: Trade | None = None
    settled: float | None = None
    bar: dict | None = None
    bars: int = 0
    day: date | None = None


@dataclass
class Order:
    ref: int
    side: int
    size: float
    kind: str
    price: float | None
    limit: float | None
    trail: float | None
    trail_percent: float | None
    valid: datetime | None
    oco: int | None
    parent: int | None
    created: datetime
    created_price: float
    tradeid: int = 0
    status: str = "Submitted"
    left: float = 0.0
    done: float = 0.0
    done_price: float = 0.0
    fees: float = 0.0
    pnl: float = 0.0
    executed: datetime | None = None
    triggered: bool = False
    waits: bool = False
    symbol: str | None = None
    bits: list[dict] = field(default_factory=list)

    @property
    def alive(self) -> bool:
        return self.status in ("Submitted", "Accepted", "Partial")

    def follow(self, price: float) -> None:
        """Moves a trailing stop, and its limit by as much, towards the price; never away from it."""
        gap = self.trail if self.trail is not None else price * (self.trail_percent or 0.0)
        stop = price + self.side * gap
        if (stop - self.price) * self.side < 0:
            if self.limit is not None:
                self.limit += stop - self.price
            self.price = stop


@dataclass
class Slippage:
    percent: float = 0.0
    fixed: float = 0.0
    at_open: bool = False
    match: bool = True
    limits: bool = True
    outside: bool = False

    def __call__(self, side: int, price: float, bound: float, slip: bool = True, limit: bool = False) -> float | None:
        """The price after slippage against the order; at most `bound` (the bar's extreme), or None if that isn't allowed."""
        if not slip or not (self.percent or self.fixed):
            return price
        moved = price * (1 + side * self.percent) if self.percent else price + side * self.fixed
        if (bound - moved) * side >= 0:
            return moved
        if self.match or (limit and self.limits):
            return moved if self.outside and not limit else bound
        return None


# Fillers: the size that a bar can take of what is left of an order.


def fixed_size(size: float | None = None) -> Callable:
    return lambda order, bar: min(bar["volume"], order.left, *((size,) if size else ()))


def bar_percent(perc: float = 100.0) -> Callable:
    return lambda order, bar: min(bar["volume"] * perc // 100, order.left)


def bar_points(minmov: float | None = None, perc: float = 100.0) -> Callable:
    """The bar's volume is spread evenly over its price points of `minmov`."""

    def take(order: Order, bar: dict) -> float:
        points = (bar["high"] - bar["low"] + minmov) // minmov if minmov else 1
        return min(order.left, bar["volume"] * perc // 100 // points)

    return take


# Sizers: the size of an order whose maker gives none.


def stake(n: float = 1, tranches: int = 1) -> Callable:
    return lambda broker, bar, side: abs(int(n / tranches)) if tranches > 1 else n


def target_stake(n: float = 1, tranches: int = 1) -> Callable:
    """A position to aim at, for `target_size`: n, or one tranche more than is held."""
    return lambda broker, bar, side: min(broker.position.size + abs(int(n / tranches)), n) if tranches > 1 else n


def reverser(n: float = 1) -> Callable:
    return lambda broker, bar, side: n * (2 if broker.position.size else 1)


def percent(percents: float = 20.0, whole: bool = False) -> Callable:
    def size(broker: Broker, bar: dict, side: int) -> float:
        n = abs(broker.position.size) or broker.cash / bar["close"] * percents / 100
        return int(n) if whole else n

    return size


def all_in(whole: bool = False) -> Callable:
    return percent(100.0, whole)


def cash_share(perc: float = 0.2) -> Callable:
    return lambda broker, bar, side: perc * broker.cash / bar["close"]


def by_side(n: float = 1) -> Callable:
    """Twice as much for a sale."""
    return lambda broker, bar, side: n if side == BUY else 2 * n


def long_only(n: float = 1) -> Callable:
    return lambda broker, bar, side: n if side == BUY or broker.position.size > 0 else 0


@dataclass
class Broker:
    """One account: cash, and a position for every symbol that it trades.

    `symbol` is the one that orders, sizers and `position` mean by default: that of the bar, in an account of several symbols the
    one set last. `commissions` has those of single symbols. `order_history` lists (dt, size, price[, symbol]), orders that are
    filled as given; `fund_history` lists (dt, share value, net asset value), which are reported from then on. With `overdraft`
    cash may fall below nothing: no order is refused for want of it.
    """

    cash: float = 10_000.0
    commission: Commission = field(default_factory=Commission)
    slippage: Slippage = field(default_factory=Slippage)
    filler: Callable | None = None
    sizer: Callable = field(default_factory=stake)
    check_submit: bool = True
    cheat_on_close: bool = False
    cheat_on_open: bool = False
    fund_start: float = 100.0
    commissions: dict[str, Commission] = field(default_factory=dict)
    order_history: list[tuple] = field(default_factory=list)
    fund_history: list[tuple] = field(default_factory=list)
    trade_history: bool = False
    overdraft: bool = False

    def __post_init__(self):
        self.books: dict[str | None, Book] = {}
        self.symbol = None
        self.submitted, self.pending, self.finished, self.closed_trades, self.histories = [], [], [], [], []
        self.refs = self.trades = 0
        self.fund_shares, self.fund_now = self.cash / self.fund_start, None
        self.executions: list[dict] = []
        self.told: list[Order] = []
        self.old_orders, self.old_funds = sorted(self.order_history, key=lambda x: x[0]), sorted(self.fund_history, key=lambda x: x[0])

    def book(self, symbol: str | None = None) -> Book:
        name = self.symbol if symbol is None else symbol
        found = self.books.get(name)
        if found is None:
            found = self.books[name] = Book()
        return found

    @property
    def position(self) -> Position:
        return self.book().position

    @property
    def bar(self) -> dict:
        return self.book().bar

    @property
    def bars(self) -> int:
        return self.book().bars

    @property
    def trade(self) -> Trade | None:
        return self.book().trade

    def on(self, symbol: str) -> Broker:
        """The same account, whose orders, sizers and position mean this symbol from now on."""
        self.symbol = symbol
        return self

    def terms(self, symbol: str | None = None) -> Commission:
        return self.commissions.get(self.symbol if symbol is None else symbol, self.commission) if self.commissions else self.commission

    # Orders

    def order(self, side: int, size: float | None = None, kind: str = MARKET, price: float | None = None, limit: float | None = None, trail: float | None = None, trail_percent: float | None = None, valid: datetime | timedelta | None = None, oco: Order | None = None, parent: Order | None = None, tradeid: int = 0, symbol: str | None = None) -> Order | None:
        if symbol is not None:
            self.symbol = symbol
        bar = self.bar
        size = self.sizer(self, bar, side) if size is None else size
        if not size:
            return None
        self.refs += 1
        now, close = bar["dt"], bar["close"]
        until = now + valid if isinstance(valid, timedelta) else valid
        o = Order(self.refs, side, abs(size), kind, price, limit, trail, trail_percent, until, oco.ref if oco else None, parent.ref if parent else None, now, close, tradeid, left=abs(size), waits=parent is not None and parent.status != "Completed", symbol=self.symbol)
        if kind in (STOP_TRAIL, STOP_TRAIL_LIMIT):
            start = close if price is None else price
            o.price = start + side * (trail if trail is not None else start * (trail_percent or 0.0)) if price is None else price
        if self.check_submit and kind != HISTORICAL:
            self.submitted.append(o)
        else:
            o.status = "Accepted"
            self.pending.append(o)
        self.told.append(o)
        return o

    def buy(self, size: float | None = None, **more) -> Order | None:
        return self.order(BUY, size, **more)

    def sell(self, size: float | None = None, **more) -> Order | None:
        return self.order(SELL, size, **more)

    def close(self, **more) -> Order | None:
        n = self.position.size
        return self.order(SELL if n > 0 else BUY, abs(n), **more) if n else None

    def bracket(self, side: int, size: float, price: float | None, stop: float, take: float, kind: str = LIMIT) -> tuple[Order, Order, Order]:
        """An entry with a stop and a limit that wake when it is filled; one of them ends the other."""
        main = self.order(side, size, kind if price is not None else MARKET, price)
        low = self.order(-side, size, STOP, stop, parent=main)
        high = self.order(-side, size, LIMIT, take, parent=main, oco=low)
        return main, low, high

    def target_size(self, size: float, **more) -> Order | None:
        gap = size - self.position.size
        return self.order(BUY if gap > 0 else SELL, abs(gap), **more) if gap else None

    def target_value(self, value: float, **more) -> Order | None:
        price = self.bar["close"]
        now = self.terms().value(self.position.size, price)
        n = self.terms().affordable(abs(value - now), price)
        return self.order(BUY if value > now else SELL, n, **more) if n else None

    def target_percent(self, share: float, **more) -> Order | None:
        return self.target_value(share * self.value(), **more)

    def cancel(self, o: Order, status: str = "Canceled") -> None:
        if o in self.pending:
            self.pending.remove(o)
            o.status = status
            self.finished.append(o)
            self.told.append(o)
            self._ended(o)

    def _ended(self, o: Order) -> None:
        """One of a group that cancels one another has ended, or a parent without a fill."""
        group = {o.ref} | ({o.oco} if o.oco else set())
        for x in [x for x in self.pending if x.oco in group or x.ref == o.oco]:
            self.cancel(x)
        if o.status != "Completed":
            for x in [x for x in self.pending if x.parent == o.ref]:
                self.cancel(x)

    def _accept(self) -> None:
        """Orders handed in are accepted or refused in turn, as if each had been filled at the price that it was made at."""
        cash, positions = self.cash, {}
        for o in self.submitted:
            if o.parent is not None and any(x.ref == o.parent and x.status in ("Margin", "Canceled") for x in self.finished):
                o.status = "Canceled"
                self.finished.append(o)
                self.told.append(o)
                continue
            c, own = self.terms(o.symbol), self.book(o.symbol)
            held = positions.setdefault(o.symbol, Position(own.position.size, own.position.price))
            price = own.bar["open"] if self.cheat_on_open and o.kind == MARKET else o.created_price
            opened, closed = held.update(o.size * o.side, price)
            if closed:
                cash += c.cost(-closed, price) if c.stock else c.cost(closed, price)
                cash -= c.fee(closed, price)
            if opened:
                cash -= c.cost(opened, price) + c.fee(opened, price)
            if self.overdraft or cash >= 0:
                o.status = "Accepted"
                self.pending.append(o)
                self.told.append(o)
            else:
                o.status = "Margin"
                self.finished.append(o)
                self.told.append(o)
                self._ended(o)
        self.submitted = []

    # Fills

    def _price(self, o: Order, bar: dict) -> float | None:
        """The price at which the bar fills the order, or None."""
        op, hi, lo, cl, side, slip = bar["open"], bar["high"], bar["low"], bar["close"], o.side, self.slippage
        far, near = (hi, lo) if side == BUY else (lo, hi)
        if o.kind == MARKET:
            return slip(side, op, far, slip.at_open)
        if o.kind == CLOSE:
            return slip(side, cl, far)
        if o.kind == HISTORICAL:
            return o.price
        if o.kind == LIMIT or o.triggered:
            want = o.limit if o.kind in (STOP_LIMIT, STOP_TRAIL_LIMIT) else o.price
            return self._limit(side, want, op, far, near)
        at_open, reached = (op - o.price) * side >= 0, (far - o.price) * side >= 0
        if o.kind in (STOP, STOP_TRAIL):
            if at_open:
                return slip(side, op, far, slip.at_open)
            if reached:
                return slip(side, o.price, far)
        elif at_open or reached:
            o.triggered = True
            if at_open:
                return self._limit(side, o.limit, op, far, near)
            if (o.limit - o.price) * side >= 0:
                return slip(side, o.price, min(far, o.limit) if side == BUY else max(far, o.limit), limit=True)
            if (op - cl) * side > 0 and (o.limit - near) * side >= 0:  # the bar went against the order after it was triggered
                return o.limit
        if o.kind in (STOP_TRAIL, STOP_TRAIL_LIMIT) and not o.triggered:
            o.follow(cl)
        return None

    def _limit(self, side: int, want: float, op: float, far: float, near: float) -> float | None:
        if (want - op) * side >= 0:
            bound = min(far, want) if side == BUY else max(far, want)
            return self.slippage(side, op, bound, self.slippage.at_open, limit=True)
        return want if (want - near) * side >= 0 else None

    def _fill(self, o: Order, price: float, bar: dict) -> None:
        size = (self.filler(o, bar) if self.filler else o.left) * o.side
        if not size:
            return
        c, own = self.terms(o.symbol), self.book(o.symbol)
        before = Position(own.position.size, own.position.price)
        if not c.stock and before.size:
            self.cash += c.settlement(before.size, own.settled, price)
        own.settled = price
        probe = Position(before.size, before.price)
        opened, closed = probe.update(size, price)
        pnl = c.profit(-closed, before.price, price) if closed else 0.0
        if closed:
            self.cash += (c.profit(-closed, before.price, price) if c.stock else 0.0) + c.cost(-closed, before.price)
            self.cash -= c.fee(closed, price)
        if opened:
            left = self.cash - c.cost(opened, price) - c.fee(opened, price)
            if left < 0 and not self.overdraft and o.kind != HISTORICAL:
                opened, size = 0.0, closed
                o.status = "Margin"
            else:
                self.cash = left
        if size:
            own.position.update(size, price)
            fees = c.fee(size, price)
            o.done_price = (o.done_price * o.done + price * abs(size)) / (o.done + abs(size))
            o.done, o.left, o.fees, o.pnl, o.executed = o.done + abs(size), o.left - abs(size), o.fees + fees, o.pnl + pnl, bar["dt"]
            o.bits.append({"ref": o.ref, "dt": bar["dt"], "size": size, "price": price, "opened": opened, "closed": closed, "comm": fees, "pnl": pnl, "psize": own.position.size, "pprice": own.position.price, "asset": o.symbol})
            self.executions.append(o.bits[-1])
            if closed and own.trade:
                own.trade.update(closed, price, c.fee(closed, price), pnl, bar["dt"], own.bars)
                if own.trade.dtclose:
                    self.closed_trades.append(own.trade)
                    own.trade = None
            if opened:
                if own.trade is None:
                    self.trades += 1
                    own.trade = Trade(self.trades, tradeid=o.tradeid, symbol=o.symbol, history=[] if self.trade_history else None)
                    if self.trade_history:
                        self.histories.append(own.trade)
                own.trade.update(opened, price, c.fee(opened, price), 0.0, bar["dt"], own.bars)
        self.told.append(o)
        if o.status == "Margin":
            self.pending.remove(o)
            self.finished.append(o)
            self._ended(o)
            return
        o.status = "Completed" if o.left <= 1e-12 else "Partial"
        if o.status == "Completed":
            self.pending.remove(o)
            self.finished.append(o)
            self._ended(o)
            for x in self.pending:
                if x.parent == o.ref:
                    x.waits = False

    def show(self, bar: dict, symbol: str | None = None) -> None:
        """The next bar of a symbol has come; nothing is filled yet."""
        self.symbol = symbol
        own = self.book(symbol)
        own.bar, own.bars = bar, own.bars + 1

    def start_bar(self, bar: dict) -> None:
        """The next bar of an account of one symbol."""
        self.show(bar)
        self.trade_on({self.symbol: bar})

    def trade_on(self, new: dict[str | None, dict]) -> None:
        """Works off orders on the new bars (by symbol, of one time), which have been shown."""
        if self.submitted:
            self._accept()
        for name, bar in new.items():
            c, own = self.terms(name), self.books[name]
            if c.interest:
                day = bar["dt"].date()
                if own.day and own.position.size:
                    self.cash -= c.credit(own.position.size, own.position.price, (day - own.day).days)
                own.day = day
        now = next(iter(new.values()))["dt"]
        while self.old_orders and self.old_orders[0][0] <= now:
            dt, size, price, *where = self.old_orders.pop(0)
            name = where[0] if where else next(iter(new))
            self.order(BUY if size > 0 else SELL, abs(size), HISTORICAL, price, symbol=name)
        while self.old_funds and self.old_funds[0][0] <= now:
            self.fund_now = self.old_funds.pop(0)[1:]
        if self.pending:
            for o in [o for o in self.pending if not o.waits]:
                bar = new.get(o.symbol)
                if bar is None or not o.alive:
                    continue
                if o.valid is not None and bar["dt"] > o.valid and o.kind != MARKET:
                    self.cancel(o, "Expired")
                    continue
                price = o.created_price if self.cheat_on_close and o.kind == MARKET else self._price(o, bar)
                if price is not None:
                    self._fill(o, price, bar)
        for name, bar in new.items():
            c, own = self.terms(name), self.books[name]
            if not c.stock and own.position.size:
                self.cash += c.settlement(own.position.size, own.settled, bar["close"])
            own.settled = bar["close"]

    def value(self) -> float:
        """Cash and all positions at their last closes; of a fund with a history, its net asset value."""
        if self.fund_now:
            return self.fund_now[1]
        return self.cash + sum(self.terms(name).value(own.position.size, own.bar["close"]) for name, own in self.books.items() if own.position.size)

    def fund_value(self) -> float:
        return self.fund_now[0] if self.fund_now else self.value() / self.fund_shares

    def add_cash(self, cash: float) -> None:
        """A deposit or withdrawal; fund shares are issued or taken back at their present value."""
        self.fund_shares += cash / self.fund_value()
        self.cash += cash


# Strategies


class CrossStrategy:
    """Long while a signal column is above 0: buys when it turns up, closes when it turns down; one order at a time,
    and with `sticky` one order in all."""

    def __init__(self, column: str = "signal", sticky: bool = False):
        self.column, self.sticky, self.open = column, sticky, None

    def next(self, broker: Broker, bar: dict) -> None:
        signal = bar[self.column]
        if self.open is not None and (self.sticky or self.open.alive):
            return
        if signal is None:
            return
        if broker.position.size and signal < 0:
            self.open = broker.close()
        elif not broker.position.size and signal > 0:
            self.open = broker.buy()


class SignalStrategy:
    """Trades from signal columns by kind: longshort, long, short, longexit, shortexit, each with _inv and _any forms.

    A positive value is a signal to buy, a negative one to sell; _inv turns it round, _any takes any value but 0. Without
    `accumulate` a position isn't added to; without `concurrent` nothing is sent while an order is pending.
    """

    def __init__(self, signals: dict[str, str], accumulate: bool = False, concurrent: bool = False):
        self.signals, self.accumulate, self.concurrent = signals, accumulate, concurrent

    def _on(self, bar: dict, kind: str, sign: int) -> bool:
        for name, column in self.signals.items():
            v = bar[column]
            if v is None or name.removesuffix("_inv").removesuffix("_any") != kind:
                continue
            if (v != 0) if name.endswith("_any") else (-v if name.endswith("_inv") else v) * sign > 0:
                return True
        return False

    def _has(self, kind: str) -> bool:
        return any(n.removesuffix("_inv").removesuffix("_any") == kind for n in self.signals)

    def next(self, broker: Broker, bar: dict) -> None:
        if (broker.pending or broker.submitted) and not self.concurrent:
            return
        both_long, both_short = self._on(bar, "longshort", 1), self._on(bar, "longshort", -1)
        long_in, short_in = self._on(bar, "long", 1), self._on(bar, "short", -1)
        leave_long = self._on(bar, "longexit", -1) or (not self._has("longexit") and self._on(bar, "long", -1))
        leave_short = self._on(bar, "shortexit", 1) or (not self._has("shortexit") and self._on(bar, "short", 1))
        size = broker.position.size
        if not size:
            if both_long or long_in:
                broker.buy()
            elif both_short or short_in:
                broker.sell()
        elif size > 0:
            if both_short or short_in:
                broker.close()
                broker.sell()
            elif leave_long:
                broker.close()
            elif self.accumulate and (both_long or long_in):
                broker.buy()
        elif both_long or long_in:
            broker.close()
            broker.buy()
        elif leave_short:
            broker.close()
        elif self.accumulate and (both_short or short_in):
            broker.sell()


_SCHEMA = pa.schema([
    ("kind", pa.string()), ("dt", pa.timestamp("us")), ("ref", pa.int64()), ("side", pa.int64()), ("type", pa.string()), ("status", pa.string()), ("created", pa.timestamp("us")), ("parent", pa.int64()), ("size", pa.float64()), ("price", pa.float64()),
    ("comm", pa.float64()), ("pnl", pa.float64()), ("pnlcomm", pa.float64()), ("long", pa.bool_()), ("dtopen", pa.timestamp("us")), ("dtclose", pa.timestamp("us")), ("barlen", pa.int64()), ("cash", pa.float64()), ("value", pa.float64()), ("fundvalue", pa.float64()), ("tradeid", pa.int64()),
    ("asset", pa.string()), ("opened", pa.float64()), ("closed", pa.float64()), ("psize", pa.float64()), ("pprice", pa.float64()),
])
_DDL = "kind string, dt timestamp_ntz, ref long, side long, type string, status string, created timestamp_ntz, parent long, size double, price double, comm double, pnl double, pnlcomm double, long boolean, dtopen timestamp_ntz, dtclose timestamp_ntz, barlen long, cash double, value double, fundvalue double, tradeid long, asset string, opened double, closed double, psize double, pprice double"


class _Run:
    """One strategy and its account, bar by bar, and the rows that come of them."""

    def __init__(self, broker: Broker, strategy: object):
        self.broker, self.strategy = broker, strategy
        hook = lambda name: getattr(strategy, name, None)
        self.prenext, self.nextstart, self.next_open = hook("prenext"), hook("nextstart"), hook("next_open") if broker.cheat_on_open else None
        self.on_order, self.on_trade, self.on_cash, self.on_fund, self.on_timer = map(hook, ("notify_order", "notify_trade", "notify_cashvalue", "notify_fund", "notify_timer"))
        self.needs, self.timers, self.started = getattr(strategy, "needs", ()), getattr(strategy, "timers", ()), False
        #: Whether a bar without orders changes nothing but the last price, and the strategy wants to know of nothing else.
        self.calm = not (self.next_open or self.on_trade or self.on_cash or self.on_fund or self.timers or self.needs or self.prenext or self.nextstart) and broker.commission.stock and not (broker.commission.interest or broker.commissions)
        if hook("start"):
            strategy.start(broker)

    def step(self, new: dict[str | None, dict], shown: object) -> None:
        """`new`: bars by symbol; `shown`: what the strategy gets of them."""
        b, s = self.broker, self.strategy
        for name, bar in new.items():
            b.show(bar, name)
        if self.next_open:
            self.next_open(b, shown)
        b.trade_on(new)
        if self.on_order:
            for o in b.told:
                self.on_order(b, o)
        b.told.clear()
        if self.on_trade:
            for t in b.closed_trades:
                self.on_trade(b, t)
        if self.on_cash:
            self.on_cash(b, b.cash, b.value())
        if self.on_fund:
            self.on_fund(b, b.cash, b.value(), b.fund_value(), b.fund_shares)
        if self.on_timer:
            for name in self.timers:
                for bar in new.values():
                    if bar[name]:
                        self.on_timer(b, name, bar["dt"])
        if not self.started and self.needs and any(bar[c] is None for bar in new.values() for c in self.needs):
            if self.prenext:
                self.prenext(b, shown)
            return
        if not self.started:
            self.started = True
            if self.nextstart:
                self.nextstart(b, shown)
                return
        s.next(b, shown)

    def step_one(self, bar: dict) -> float:
        """The same for an account of one symbol; returns its value."""
        b = self.broker
        if self.calm and not (b.submitted or b.pending or b.old_orders or b.old_funds or b.told):
            own = b.books.get(None) or b.book()
            own.bar, own.bars, own.settled = bar, own.bars + 1, bar["close"]
            self.strategy.next(b, bar)
        else:
            self.step({None: bar}, bar)
            own = b.books[None]
        if b.fund_now:
            return b.value()
        return b.cash + own.position.size * bar["close"] if self.calm else b.value()

    def rows(self) -> list[dict]:
        b = self.broker
        if not (b.finished or b.closed_trades or b.executions or b.histories):
            return []
        out = [*(_order_row(o, "order") for o in b.finished), *(_trade_row(t) for t in b.closed_trades), *({"kind": "execution"} | x for x in b.executions)]
        for t in b.histories:
            out += [{"kind": "history", "ref": t.ref, "tradeid": t.tradeid, "asset": t.symbol, "long": t.long} | x for x in t.history]
            t.history.clear()
        b.finished, b.closed_trades, b.executions, b.histories = [], [], [], [t for t in b.histories if not t.dtclose]
        return out

    def end(self) -> list[dict]:
        if hasattr(self.strategy, "stop"):
            self.strategy.stop(self.broker)
        return [_order_row(o, "open") for o in (*self.broker.pending, *self.broker.submitted)]


def _order_row(o: Order, kind: str) -> dict:
    return {"kind": kind, "dt": o.executed, "ref": o.ref, "side": o.side, "type": o.kind, "status": o.status, "created": o.created, "parent": o.parent, "size": o.done or o.size, "price": o.done_price if o.done else o.created_price, "comm": o.fees, "pnl": o.pnl, "tradeid": o.tradeid, "asset": o.symbol}


def _trade_row(t: Trade) -> dict:
    return {"kind": "trade", "dt": t.dtclose, "ref": t.ref, "price": t.price, "comm": t.commission, "pnl": t.pnl, "pnlcomm": t.pnlcomm, "long": t.long, "dtopen": t.dtopen, "dtclose": t.dtclose, "barlen": t.barclose - t.baropen, "tradeid": t.tradeid, "asset": t.symbol}


def simulate(bars: DataFrame, strategy: Callable[[dict], object], broker: Callable[[dict], Broker] = lambda first: Broker(), keys: tuple[str, ...] = ("symbol",), asset: str | None = None, variants: list[dict] | None = None, spread: int = 1) -> DataFrame:
    """Events of all runs: the keys, and rows of kind order (when it ends), open (orders left at the end), execution, trade,
    history (of trades, if the broker keeps it) and equity.

    `strategy` and `broker` make a run's own objects from its first row, which has the parameters of the run. With `asset`, a column
    that isn't a key, a run is one account over several symbols: bars of one time come together, as a dict by symbol. With
    `variants`, every run is done once for each of them, in one pass over its bars: they are added to the row that the makers
    get, and their number is the column param_id. Bars are copied and shuffled `spread` times (never more than there are variants),
    and each copy does its share of them: few long series keep more tasks busy then.
    """
    keys, spread = tuple(keys), max(1, min(spread, len(variants or ())))
    if spread > 1:
        bars = bars.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    shown_keys = (*keys, "param_id") if variants is not None else keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, runs, out, curve, schema, mine, labels = None, [], [], [], None, [], []
        shown = (*shown_keys, "dt", "cash", "value", "fundvalue", "size", "price")
        held: tuple | None = None  # time and bars that wait for others of the same time
        parts, now = ((*keys, "_share") if spread > 1 else keys), None

        def label(k: int) -> tuple:
            return (*last, mine[k][0]) if variants is not None else last

        def step(dt: datetime, new: dict | None, given: dict) -> None:
            for k, r in enumerate(runs):
                b = r.broker
                if new is None:
                    value = r.step_one(given)
                else:
                    r.step(new, given)
                    value = b.value()
                key = labels[k]
                if b.finished or b.executions or b.closed_trades:
                    named = dict(zip(shown_keys, key, strict=True))
                    out.extend(named | x for x in r.rows())
                p = b.books[None].position if new is None else None
                curve.append((*key, dt, b.cash, value, b.fund_now[0] if b.fund_now else value / b.fund_shares, p.size if p else None, p.price if p else None))

        def end() -> None:
            for k, r in enumerate(runs):
                out.extend(dict(zip(shown_keys, label(k), strict=True)) | x for x in r.end())

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
            if curve:
                made, n = dict(zip(shown, zip(*curve, strict=True), strict=True)), len(curve)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.array(["equity"] * n) if f.name == "kind" else pa.nulls(n, f.type) for f in schema], schema=schema)
                curve.clear()

        def begin(bar: dict) -> list[_Run]:
            share = bar.get("_share", 0) if spread > 1 else 0
            mine[:] = list(enumerate(variants))[share::spread] if variants is not None else [(0, {})]
            labels[:] = [label(k) for k in range(len(mine))]
            return [_Run(broker(first), strategy(first)) for first in [bar | v for _, v in mine]]

        for batch in batches:
            if schema is None:
                schema = pa.schema([batch.schema.field(k) for k in keys] + ([("param_id", pa.int64())] if variants is not None else []) + list(_SCHEMA))
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bar = dict(zip(names, row, strict=True))
                key = tuple(bar[k] for k in parts)
                if held and (key != now or bar["dt"] != held[0]):
                    step(held[0], held[1], held[1])
                    held = None
                if key != now:
                    end()
                    last, now = key[: len(keys)], key
                    runs = begin(bar)
                if asset is None:
                    step(bar["dt"], None, bar)
                else:
                    held = held or (bar["dt"], {})
                    held[1][bar[asset]] = bar
            yield from flush()
        if held:
            step(held[0], held[1], held[1])
        end()
        if schema:
            yield from flush()

    from pyspark.sql import types as T

    fields = T.StructType([bars.schema[k] for k in keys] + ([T.StructField("param_id", T.LongType())] if variants is not None else []) + T.DataType.fromDDL(_DDL).fields)
    by = (*keys, "_share") if spread > 1 else keys
    return in_order(bars, by, "dt", *([asset] if asset else [])).mapInArrow(run, fields)


def orders(events: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return events.where("kind IN ('order', 'open')").select(*keys, "asset", "ref", "parent", "side", "type", "status", "created", F.col("dt").alias("executed"), "size", "price", "comm", "pnl")


def executions(events: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The bits in which orders were filled, each with the position after it."""
    return events.where("kind = 'execution'").select(*keys, "asset", "ref", "dt", "size", "price", "comm", "pnl", "opened", "closed", "psize", "pprice")


def trade_updates(events: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every change of every trade, of brokers that keep their history."""
    return events.where("kind = 'history'").select(*keys, "asset", "ref", "status", "dt", "size", "price", "pnl", "pnlcomm", "barlen")


def trades(events: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return events.where("kind = 'trade'").select(*keys, "asset", "ref", "tradeid", "long", "dtopen", "dtclose", "barlen", "price", "pnl", "comm", "pnlcomm")


def equity(events: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return events.where("kind = 'equity'").select(*keys, "dt", "cash", "value", "fundvalue", "size", "price")


def sweep(**parameters: list) -> list[dict]:
    """Every combination of the parameters, for the `variants` of a simulation."""
    import itertools

    return [dict(zip(parameters, map(float, v), strict=True)) for v in itertools.product(*parameters.values())]
