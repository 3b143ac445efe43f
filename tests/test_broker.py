import datetime as dt

import pytest
from helpers import BARS, walk
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.operators import broker as B

DAY = dt.timedelta(days=1)


def bar(k, o, h, lo, c, v=100.0):
    return {"dt": dt.datetime(2024, 1, 1) + k * DAY, "open": o, "high": h, "low": lo, "close": c, "volume": v}


def play(broker, bars, actions):
    made = {}
    for k, b in enumerate(bars):
        broker.start_bar(bar(k, *b))
        if k in actions:
            made[k] = actions[k](broker)
    return made


def test_average_price():
    p = B.Position(10, 10.0)
    assert p.update(5, 12.5) == (5, 0) and p.size == 15 and round(p.price, 6) == round((100 + 62.5) / 15, 6)
    before = p.price
    assert p.update(-7, 14.5) == (0, -7) and p.size == 8 and p.price == before
    assert p.update(-15, 17.5) == (-7, -8) and p.size == -7 and p.price == 17.5


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(1, 50)), max_size=30))
def test_opened_and_closed_add_up(fills):
    p = B.Position()
    total = 0
    for size, price in fills:
        if size:
            opened, closed = p.update(size, price)
            assert opened + closed == size
            total += size
            assert p.size == total and (p.size or p.price == 0)


def test_commission():
    s, f = B.Commission(0.5), B.Commission(0.5, mult=10, margin=10)
    assert (s.cost(100, 10), s.fee(100, 10), s.profit(100, 10, 5), s.settlement(100, 10, 5)) == (1000, 500, -500, 0)
    assert (f.cost(100, 10), f.fee(100, 10), f.profit(100, 10, 5), f.settlement(100, 10, 5)) == (1000, 50, -5000, -5000)


def test_market_orders_fill_at_the_next_open():
    b = B.Broker()
    made = play(b, [(10, 11, 9, 10), (12, 13, 11, 12), (14, 15, 13, 14)], {0: lambda b: b.buy(2), 1: lambda b: b.close()})
    assert (made[0].done_price, made[1].done_price) == (12, 14) and b.cash == 10_004 and b.closed_trades[0].pnl == 4


@pytest.mark.parametrize(("kind", "kw", "bars", "price"), [
    (B.LIMIT, {"price": 9.5}, [(10, 11, 10, 10), (10, 11, 9, 10)], 9.5), (B.LIMIT, {"price": 9.5}, [(10, 11, 10, 10), (9, 11, 9, 10)], 9), (B.LIMIT, {"price": 8.0}, [(10, 11, 10, 10), (9, 11, 9, 10)], None),
    (B.STOP, {"price": 11.0}, [(10, 10, 10, 10), (10, 12, 9, 10)], 11), (B.STOP, {"price": 11.0}, [(10, 10, 10, 10), (12, 12, 9, 10)], 12), (B.STOP, {"price": 13.0}, [(10, 10, 10, 10), (12, 12, 9, 10)], None),
    (B.STOP_LIMIT, {"price": 11.0, "limit": 11.5}, [(10, 10, 10, 10), (10, 12, 9, 11)], 11), (B.STOP_LIMIT, {"price": 11.0, "limit": 10.5}, [(10, 10, 10, 10), (10, 12, 9.9, 11), (10.8, 11, 10, 10)], 10.5),
    (B.CLOSE, {}, [(10, 10, 10, 10), (10, 12, 9, 11)], 11),
])
def test_fills(kind, kw, bars, price):
    made = play(B.Broker(), bars, {0: lambda b: b.buy(1, kind=kind, **kw)})
    assert (made[0].done_price if made[0].done else None) == price


def test_a_trailing_stop_only_moves_towards_the_price():
    b = B.Broker()
    made = play(b, [(10, 10, 10, 10), (10, 10, 10, 10), (10, 14, 10, 14), (13, 13, 12.5, 13), (13, 13, 11, 11)], {0: lambda b: b.buy(1), 1: lambda b: b.sell(1, kind=B.STOP_TRAIL, trail=2.0)})
    assert made[1].done_price == 12 and b.position.size == 0


def test_orders_expire_and_cancel_one_another():
    b = B.Broker()
    play(b, [(10, 10, 10, 10)] * 5, {0: lambda b: b.buy(1, kind=B.LIMIT, price=5.0, valid=2 * DAY)})
    assert [o.status for o in b.finished] == ["Expired"]
    b = B.Broker()

    def pair(b):
        first = b.buy(1, kind=B.LIMIT, price=9.0)
        return first, b.buy(1, kind=B.STOP, price=12.0, oco=first)

    made = play(b, [(10, 10, 10, 10), (10, 13, 10, 10), (9, 9, 8, 9)], {0: pair})
    assert [o.status for o in made[0]] == ["Canceled", "Completed"] and b.position.size == 1


def test_a_bracket_wakes_after_its_entry():
    b = B.Broker()
    made = play(b, [(10, 10, 10, 10), (10, 10, 9, 10), (10, 16, 10, 12)], {0: lambda b: b.bracket(B.BUY, 1, 9.5, 8.0, 15.0)})
    assert [o.status for o in made[0]] == ["Completed", "Canceled", "Completed"] and b.cash == 10_000 - 9.5 + 15 and not b.pending


def test_cash_bounds_what_is_opened():
    b = B.Broker(cash=50.0)
    made = play(b, [(10, 10, 10, 10), (10, 10, 10, 10)], {0: lambda b: b.buy(6)})
    assert made[0].status == "Margin" and b.position.size == 0
    b = B.Broker(cash=50.0)
    made = play(b, [(10, 10, 10, 10), (20, 20, 20, 20)], {0: lambda b: b.buy(4)})
    assert made[0].status == "Margin" and b.cash == 50


def test_an_overdraft_bounds_nothing():
    b = B.Broker(cash=50.0, overdraft=True)
    made = play(b, [(10, 10, 10, 10), (20, 20, 20, 20), (5, 5, 5, 5), (5, 5, 5, 5), (4, 4, 4, 4)], {0: lambda b: b.buy(6), 1: lambda b: b.close(), 2: lambda b: b.buy(1)})
    assert [made[k].status for k in range(3)] == ["Completed"] * 3 and b.cash == 50 - 120 + 30 - 5 and b.value() == -41 and b.closed_trades[0].pnl == -90


def test_an_order_without_end_is_never_done():
    b = B.Broker(cash=50.0, overdraft=True, filler=B.bar_percent(50))
    made = play(b, [(10, 10, 10, 10)] * 5, {0: lambda b: b.buy(float("inf"))})
    assert made[0].status == "Partial" and made[0].done == b.position.size == 200 and b.cash == 50 - 2000 and [x["psize"] for x in b.executions] == [50, 100, 150, 200]


def test_slippage_fillers_and_sizers():
    b = B.Broker(slippage=B.Slippage(percent=0.1, at_open=True))
    assert play(b, [(10, 10, 10, 10), (10, 10.5, 9, 10)], {0: lambda b: b.buy(1)})[0].done_price == 10.5
    b = B.Broker(filler=B.bar_percent(10))
    made = play(b, [(10, 10, 10, 10, 20.0)] * 4, {0: lambda b: b.buy(5)})
    assert made[0].done == 5 and len(b.executions) == 3
    b = B.Broker(sizer=B.percent(50.0, whole=True))
    assert play(b, [(10, 10, 10, 10), (10, 10, 10, 10)], {0: lambda b: b.buy()})[0].done == 500
    b = B.Broker()
    play(b, [(10, 10, 10, 10), (10, 10, 10, 10)], {0: lambda b: b.target_percent(0.5)})
    assert b.position.size == 500


def test_interest_and_deposits():
    b = B.Broker(commission=B.Commission(interest=0.365))
    play(b, [(10, 10, 10, 10)] * 3, {0: lambda b: b.sell(10)})
    assert round(b.cash, 6) == 10_000 + 100 - 0.1
    b = B.Broker()
    play(b, [(10, 10, 10, 10)], {0: lambda b: b.add_cash(5000)})
    assert b.fund_shares == 150 and b.value() / b.fund_shares == 100


def test_submitted_orders_are_checked_together():
    b = B.Broker(cash=100.0)
    made = play(b, [(60, 60, 60, 60), (60, 60, 60, 60), (60, 60, 60, 60)], {0: lambda b: (b.buy(1), b.buy(1))})
    assert [o.status for o in made[0]] == ["Completed", "Margin"] and b.cash == 40 and b.position.size == 1
    b = B.Broker(cash=100.0)
    made = play(b, [(60, 60, 60, 60)] * 4, {0: lambda b: b.buy(1), 1: lambda b: (b.close(), b.buy(1))})
    assert [o.status for o in made[1]] == ["Completed", "Completed"] and b.position.size == 1
    b = B.Broker(cash=100.0, check_submit=False)
    made = play(b, [(60, 60, 60, 60)] * 2, {0: lambda b: (b.buy(1), b.buy(1))})
    assert [o.status for o in made[0]] == ["Completed", "Margin"]


def run(bars, strategy, broker):
    r = B._Run(broker, strategy)
    for k, b in enumerate(bars):
        one = b if isinstance(b, dict) else {None: bar(k, *b)}
        r.step(one, one if isinstance(b, dict) else one[None])
    return r


def test_cheating_on_the_open():
    class AtOpen:
        def __init__(self):
            self.n = 0

        def next_open(self, b, bar):
            self.n += 1
            if self.n == 2:
                b.buy(1)

        def next(self, b, bar):
            pass

    bars = [(10, 10, 10, 10), (20, 25, 20, 25), (30, 30, 30, 30)]
    r = run(bars, AtOpen(), B.Broker(cheat_on_open=True))
    assert [(x["price"], x["dt"].day) for x in r.broker.executions] == [(20, 2)]
    assert not run(bars, AtOpen(), B.Broker()).broker.executions
    # what an order may cost is judged by the open that it is filled at
    assert run(bars, AtOpen(), B.Broker(cash=22.0, cheat_on_open=True)).broker.position.size == 1


def test_one_purse_for_several_symbols():
    class Both:
        def next(self, b, bars):
            for name in bars:
                if not b.on(name).position.size and not b.submitted:
                    b.buy(1, symbol=name)

    two = lambda k, a, z: {"A": bar(k, a, a, a, a), "Z": bar(k, z, z, z, z)}
    r = run([two(0, 60, 50), two(1, 60, 50), two(2, 60, 50), two(3, 70, 50)], Both(), B.Broker(cash=100.0))
    assert {k: x.position.size for k, x in r.broker.books.items()} == {"A": 1, "Z": 0} and r.broker.cash == 40 and r.broker.value() == 110
    assert {o.status for o in r.broker.finished if o.symbol == "Z"} == {"Margin"}
    r = run([two(0, 60, 50), two(1, 60, 50), {"Z": bar(2, 55, 55, 55, 55)}, two(3, 70, 50)], Both(), B.Broker(cash=1000.0, commissions={"Z": B.Commission(1.0, percent=False)}))
    assert r.broker.cash == 1000 - 60 - 55 - 1 and r.broker.value() == 1000 - 60 - 55 - 1 + 70 + 50


def test_hooks_are_called():
    calls = []

    class Told:
        needs, timers = ("mean",), ("ring",)

        def start(self, b):
            calls.append("start")

        def prenext(self, b, bar):
            calls.append("prenext")

        def nextstart(self, b, bar):
            calls.append("nextstart")
            b.buy(1)

        def next(self, b, bar):
            calls.append("next")
            b.close()

        def notify_order(self, b, o):
            calls.append(f"order {o.status}")

        def notify_trade(self, b, t):
            calls.append(f"trade {t.pnl}")

        def notify_cashvalue(self, b, cash, value):
            calls.append(f"cash {cash}")

        def notify_fund(self, b, cash, value, fundvalue, shares):
            assert shares == 1 and fundvalue == value

        def notify_timer(self, b, name, dt):
            calls.append(f"{name} {dt.day}")

        def stop(self, b):
            calls.append("stop")

    r = B._Run(B.Broker(cash=100.0), Told())
    for k, mean in enumerate([None, 1.0, 1.0, 1.0]):
        one = bar(k, 10 + k, 10 + k, 10 + k, 10 + k) | {"mean": mean, "ring": k == 2}
        r.step({None: one}, one)
    r.end()
    assert calls == ["start", "cash 100.0", "prenext", "cash 100.0", "nextstart", "order Completed", "order Completed", "order Completed", "cash 88.0", "ring 3", "next", "order Completed", "order Completed", "order Completed", "trade 1.0", "cash 101.0", "next", "stop"]


def test_histories():
    day = lambda k: dt.datetime(2024, 1, 1) + k * DAY

    class Idle:
        def next(self, b, bar):
            pass

    b = B.Broker(order_history=[(day(1), 5, 9.0), (day(2), -5, 12.0)], fund_history=[(day(2), 101.0, 5000.0)], trade_history=True)
    r = run([(10, 10, 10, 10)] * 4, Idle(), b)
    assert [(x["size"], x["price"], x["pnl"]) for x in b.executions] == [(5, 9.0, 0.0), (-5, 12.0, 15.0)] and b.value() == 5000 and b.fund_value() == 101
    assert [(x["status"], x["size"], x["pnl"]) for x in r.rows() if x["kind"] == "history"] == [("Open", 5, 0.0), ("Closed", 0, 15.0)]


def test_runs_are_independent_of_partitions(spark):
    from barloom.operators.indicators import CLOSE, crossing, sma
    from barloom.plans.lines import with_lines

    df = with_lines(spark.createDataFrame(walk(80) + walk(80, "B", 2) + walk(80, "C", 3), BARS), {"signal": crossing(CLOSE, sma(CLOSE, 10))})
    one = B.simulate(df.coalesce(1), lambda f: B.CrossStrategy())
    two = B.simulate(df.repartition(7), lambda f: B.CrossStrategy())
    key = lambda r: str(tuple(r))
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key)
    assert B.trades(one).count() > 3 and B.equity(one).count() == 240
