import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.sim.desk import Desk, Settings, State, Strategy, expiry_of, resume
from barloom.sim.grid import grid_nav, step_clean
from barloom.sim.rules import Book, Contract, Costs, Fill, FREE, affordable, futures_fill
from barloom.sim.strategies import BuyAndHold, DualMA, DualMASymmetric, FuturesShort

SYM = "600000.SH"


def market(closes, symbol=SYM, factors=None, before=None, start="2024-01-02"):
    days = pd.bdate_range(start, periods=len(closes))
    c = np.array(closes, dtype=float)
    o = c * 0.99
    return pd.DataFrame({"symbol": symbol, "date": days, "open": o, "high": np.maximum(o, c) * 1.01, "low": np.minimum(o, c) * 0.99, "close": c, "pre_close": before if before is not None else np.r_[c[0], c[:-1]], "adj_factor": factors if factors is not None else 1.0})


def run(strategy, bars, **kw):
    desk = Desk(strategy, Settings(**{"weight_cap": None, "costs": FREE} | kw))
    rows = desk.run(bars)
    names = ("kind", "at", "symbol", "side", "qty", "price", "value", "fees", "cash", "pnl", "closing", "code")
    return desk, pd.DataFrame(rows, columns=names)


UP = [10 + 0.1 * i for i in range(10)]


def test_buy_and_hold():
    desk, r = run(BuyAndHold(symbols=[SYM]), market(UP))
    t = r[r.kind == "trade"]
    assert len(t) == 1 and t.price.iloc[0] == pytest.approx(10.1 * 0.99) and t.qty.iloc[0] == 100_000
    nav = r[r.kind == "nav"]
    assert nav.value.iloc[-1] == pytest.approx(100_000 * 10.9 + 100) and t["at"].iloc[0] > nav["at"].iloc[0]


def test_same_close_and_determinism():
    _, r = run(BuyAndHold(symbols=[SYM]), market(UP), execution="same_close")
    t = r[r.kind == "trade"].iloc[0]
    assert t.price == 10.0 and t["at"] == r[r.kind == "nav"]["at"].iloc[0]
    assert run(BuyAndHold(symbols=[SYM]), market(UP))[1].equals(run(BuyAndHold(symbols=[SYM]), market(UP))[1])


class Always(Strategy):
    def on_signal(self, ctx):
        ctx.order_target_percent(SYM, 1.0)


def test_weight_cap_counts_what_is_held():
    _, r = run(Always(), market(UP), weight_cap=0.5)
    assert r[r.kind == "trade"].qty.tolist() == [50_000.0] and "WEIGHT_CAP" in set(r.code)


def test_halt_sells_and_refuses():
    desk, r = run(Always(), market([20 - i for i in range(12)]), halt=0.1)
    assert "HALTED" in set(r.code) and (r[r.kind == "trade"].side == "sell").any() and not desk.state.book.holdings


def test_split_keeps_value():
    closes, factors = [20.0] * 4 + [10.0] * 4, [1.0] * 4 + [2.0] * 4
    desk, r = run(BuyAndHold(symbols=[SYM]), market(closes, factors=factors, before=[20.0] * 4 + [10.0] * 4))
    h = desk.state.book.of(SYM)
    assert h.shares == 100_000 and h.cost == pytest.approx(9.9)
    nav = r[r.kind == "nav"].value.tolist()
    assert nav[3] == pytest.approx(nav[4]) and len(r[r.kind == "action"]) == 1


def test_no_bar_suspends():
    class Second(Strategy):
        def on_signal(self, ctx):
            if ctx.now == pd.Timestamp("2024-01-03"):
                ctx.order_target_percent(SYM, 1.0)

    bars = market([10.0] * 6)
    ticks = bars["date"].tolist()
    desk = Desk(Second(), Settings())
    desk.run(bars.drop(index=2), ticks)
    assert "SUSPENDED" in {x[-1] for x in desk.rows}


def test_limits_lots_and_next_day():
    class Day(Strategy):
        def setup(self, ctx):
            self.i = 0

        def on_signal(self, ctx):
            self.i += 1
            if self.i == 1:
                ctx.order(SYM, 150)
            if self.i == 2:
                ctx.order(SYM, 50)
                ctx.order(SYM, -100)
            if self.i == 3:
                ctx.order(SYM, 100)
                ctx.order(SYM, -500)

    _, r = run(Day(), market([10.0, 10.0, 10.0, 10.0, 10.0]))
    assert r[r.kind == "trade"].qty.tolist() == [100.0, 100.0, 100.0]
    assert set(r[r.kind == "rejection"].code) == {"LOT_TOO_SMALL", "T_PLUS_ONE"}
    jump = market([10.0, 10.0, 10.0])
    jump.loc[1, "open"] = 11.0
    _, r = run(BuyAndHold(symbols=[SYM]), jump)
    assert "LIMIT_UP" in set(r.code)


def test_cash_cap_pays_for_fees():
    c = Costs()
    for cash in (1_000.0, 9_999.0, 1e6, 123_456.78):
        q = affordable(1e9, 9.87, cash, 100.0, c)
        value = q * c.price(9.87, "buy")
        assert q % 100 == 0 and value + c.stock(value, "buy") <= cash + 1e-6


def test_futures_accounting_and_fees():
    b = Book(1e6, multipliers={"RB2505.SHFE": 10.0})
    b.trade("RB2505.SHFE", 10, 100.0, 0.0)
    assert b.trade("RB2505.SHFE", -25, 110.0, 0.0) == pytest.approx(1000)
    assert b.of("RB2505.SHFE").shares == -15 and b.of("RB2505.SHFE").cost == 110.0
    f = futures_fill("sell", 10_000, 99.0, 100.0, contract=Contract(10.0, 0.13, 0.07), held=0.0, opened_today=0.0, headroom=1e6, costs=FREE)
    assert f.qty == 7770
    f = futures_fill("sell", 5, 100.0, 100.0, contract=Contract(10.0, 0.13, 0.07), held=5.0, opened_today=5.0, headroom=1e6, costs=Costs(futures_slippage_bps=0.0))
    assert f.fees == pytest.approx(2.5) and f.closed_today == 5


def test_futures_run_to_their_expiry():
    assert expiry_of("RB2505.SHFE") == dt.date(2025, 5, 15) and expiry_of("IF2412.CFE") == dt.date(2024, 12, 20) and expiry_of("RB.SHFE") is None

    class Again(FuturesShort):
        def on_signal(self, ctx):
            super().on_signal(ctx)
            if ctx.now >= pd.Timestamp("2025-05-15"):
                ctx.order("RB2505.SHFE", -1)

    desk, r = run(Again(symbols=["RB2505.SHFE"], lots=2), market([100.0] * 12, "RB2505.SHFE", start="2025-05-08"))
    assert not desk.state.book.holdings and "EXPIRED" in set(r.code)


def test_turning_around():
    desk, r = run(DualMASymmetric(symbols=["RB.SHFE"], fast=2, slow=3, lots=3), market([100, 101, 102, 103, 100, 97, 95, 94], "RB.SHFE"))
    assert desk.state.book.of("RB.SHFE").shares == -3 and 6 in r[r.kind == "trade"].qty.tolist()


def test_resumed_run_is_the_run():
    bars = market([10 + np.sin(i / 3) for i in range(40)])
    make = lambda: DualMA(symbols=[SYM], fast=2, slow=5)
    s = Settings(weight_cap=0.95, carry_pending=True)
    whole = Desk(make(), s).run(bars)
    text, rows = None, []
    for n in (13, 27, 27, 40):
        text, more = resume(text, make(), s, bars.iloc[:n])
        rows += more
    assert rows == whole
    assert State.load(text).dump() == text


def test_halt_survives_a_restart():
    bars = market([20 - i for i in range(12)])
    s = Settings(weight_cap=None, halt=0.1, carry_pending=True, costs=FREE)
    text, _ = resume(None, Always(), s, bars.iloc[:6])
    assert State.load(text).halted
    _, rows = resume(text, Always(), s, bars)
    assert {x[-1] for x in rows if x[0] == "rejection"} == {"HALTED"} and not any(x[0] == "trade" and x[3] == "buy" for x in rows)


def test_minutes_release_on_a_new_day():
    times = [pd.Timestamp("2024-01-02 09:35") + pd.Timedelta(minutes=5 * i) for i in range(4)] + [pd.Timestamp("2024-01-03 09:35") + pd.Timedelta(minutes=5 * i) for i in range(4)]
    bars = pd.DataFrame({"symbol": SYM, "date": times, "open": 10.0, "high": 10.0, "low": 10.0, "close": 10.0, "pre_close": 10.0, "adj_factor": 1.0})

    class Turn(Strategy):
        def setup(self, ctx):
            self.i = 0

        def on_signal(self, ctx):
            self.i += 1
            ctx.order(SYM, 100 if self.i == 1 else -100) if self.i <= 2 or self.i == 5 else None

    _, r = run(Turn(), bars, intraday=True)
    assert "T_PLUS_ONE" in set(r.code) and r[r.kind == "trade"].side.tolist() == ["buy", "sell"]
    _, r = run(Turn(), bars, intraday=True, trigger_times=("09:40",))
    assert r[r.kind == "trade"].side.tolist() == ["buy", "sell"] and set(r[r.kind == "trade"]["at"].dt.strftime("%H:%M")) == {"09:45"}


def test_small_folds():
    assert step_clean(np.array([np.nan, 1.0, 1.004, 1.006, np.nan, 1.01])).tolist()[1:] == [1.0, 1.0, 1.006, 1.006, 1.006]
    nav = grid_nav(np.array([10.0, 9.0, 8.0, 9.0, 10.0]), 0.08, 10)
    assert nav[0] == 1 and nav[-1] > 1 and len(grid_nav(np.array([]), 0.1, 3)) == 0


def test_bad_settings():
    with pytest.raises(ValueError):
        Settings(execution="now")
    with pytest.raises(ValueError):
        Settings(intraday=True, execution="same_close")
    assert Fill().rejected is None
