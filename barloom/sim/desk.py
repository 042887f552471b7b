"""Portfolio simulation: a pure fold over ticks, run for many portfolios at once as grouped folds."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barloom.functions import market as K
from barloom.sim.rules import Book, Contract, Costs, Fill, Holding, board_limit, futures_fill, same_day, stock_fill

_CONTRACTS = {p: Contract(m, g, l) for p, m, g, _, _, _, l in K.CONTRACTS}
_OTHER = Contract(K.OTHER_CONTRACT[0], K.OTHER_CONTRACT[1], K.OTHER_CONTRACT[5])


def contract_of(symbol: str) -> Contract | None:
    code, _, place = symbol.partition(".")
    if place not in K.FUTURES_EXCHANGES:
        return None
    return _CONTRACTS.get(code.rstrip("0123456789").upper(), _OTHER)


def expiry_of(symbol: str) -> dt.date | None:
    code, _, place = symbol.partition(".")
    digits = code[len(code.rstrip("0123456789")):]
    if not digits:
        return None
    year, month = (2000 + int(digits[:2]), int(digits[2:])) if len(digits) == 4 else (2020 + int(digits[0]), int(digits[1:]))
    first = dt.date(year, month, 1)
    if place == "CFE":
        return first + dt.timedelta(days=(4 - first.weekday()) % 7 + 14)
    return first + dt.timedelta(days=14)


@dataclass(frozen=True)
class Settings:
    execution: str = "next_open"
    cash: float = 1e6
    weight_cap: float | None = 0.95
    halt: float | None = None
    lot: float = 100.0
    costs: Costs = Costs()
    trigger_times: tuple[str, ...] = ()
    intraday: bool = False
    carry_pending: bool = False

    def __post_init__(self):
        if self.execution not in ("next_open", "same_close"):
            raise ValueError("execution is next_open or same_close")
        if self.intraday and self.execution != "next_open":
            raise ValueError("intraday bars fill at the next open")


@dataclass
class Order:
    symbol: str
    side: str
    qty: float
    origin: str = "strategy"


@dataclass
class State:
    """All a simulation needs to go on later; to and from JSON."""

    book: Book
    pending: list[Order] = field(default_factory=list)
    factors: dict[str, float] = field(default_factory=dict)
    opened_today: dict[str, float] = field(default_factory=dict)
    closes: dict[str, float] = field(default_factory=dict)
    peak: float = 0.0
    halted: bool = False
    day: str | None = None
    last: str | None = None

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> State:
        d = json.loads(text)
        b = d.pop("book")
        book = Book(b["cash"], {s: Holding(**h) for s, h in b["holdings"].items()}, b["multipliers"])
        return cls(book=book, pending=[Order(**o) for o in d.pop("pending")], **d)


ROW = ("kind", "at", "symbol", "side", "qty", "price", "value", "fees", "cash", "pnl", "closing", "code")
SCHEMA = "kind string, at timestamp, symbol string, side string, qty double, price double, value double, fees double, cash double, pnl double, closing boolean, code string"


class Context:
    """What a strategy sees and does on a tick: prices up to now, holdings, orders for the next fill."""

    def __init__(self, desk: Desk):
        self._desk = desk
        self.params: dict = {}

    @property
    def now(self) -> pd.Timestamp:
        return self._desk.now

    @property
    def total_value(self) -> float:
        return self._desk.nav()

    @property
    def cash(self) -> float:
        return self._desk.state.book.cash

    def position(self, symbol: str) -> Holding:
        return self._desk.state.book.of(symbol)

    def price(self, symbol: str) -> float | None:
        return self._desk.state.closes.get(symbol)

    def history(self, symbol: str, n: int, column: str = "close") -> np.ndarray:
        """The last n ticks including this one; NaN where the symbol has no bar."""
        return self._desk.history(symbol, n, column)

    def order(self, symbol: str, qty: float) -> None:
        """Buy if positive, sell if negative."""
        if qty:
            self._desk.submit(Order(symbol, "buy" if qty > 0 else "sell", abs(qty)))

    def order_value(self, symbol: str, value: float) -> None:
        if (p := self.price(symbol)) and p > 0:
            self.order(symbol, value / p)

    def order_target_value(self, symbol: str, value: float) -> None:
        if (p := self.price(symbol)) and p > 0:
            self.order(symbol, (value - self.position(symbol).shares * p) / p)

    def order_target_percent(self, symbol: str, share: float) -> None:
        """Towards a share of the total value; changes under half a percent of it are left."""
        if not 0 <= share <= 1:
            raise ValueError("a target share is between 0 and 1")
        total, p = self.total_value, self.price(symbol)
        if not p or p <= 0 or total <= 0:
            return
        change = share * total - self.position(symbol).shares * p
        if abs(change) / total >= 0.005:
            self.order(symbol, change / p)

    def cancel_all(self) -> None:
        self._desk.state.pending.clear()


class Strategy:
    """Hooks in the order of a day; all are optional. ``lookback`` is how many days of history the hooks see at most; None is all of it."""

    lookback: int | None = None

    def __init__(self, **params):
        self.params = params

    def setup(self, ctx: Context) -> None: ...

    def on_market_open(self, ctx: Context) -> None: ...

    def on_signal(self, ctx: Context) -> None: ...

    def on_market_close(self, ctx: Context) -> None: ...

    def on_stop(self, ctx: Context) -> None: ...


class Desk:
    """One portfolio. ``run`` folds the bars of a group into tagged rows: nav, trade, rejection, action."""

    def __init__(self, strategy: Strategy, settings: Settings = Settings(), state: State | None = None):
        self.strategy, self.settings = strategy, settings
        self.state = state or State(Book(settings.cash))
        self.rows: list[tuple] = []
        self.now: pd.Timestamp | None = None
        self._frames: dict[str, dict[str, np.ndarray]] = {}
        self._ticks: list[pd.Timestamp] = []
        self._i = 0

    # Access for the strategy.
    def history(self, symbol: str, n: int, column: str) -> np.ndarray:
        frame = self._frames.get(symbol)
        if frame is None:
            return np.full(min(n, self._i + 1), np.nan)
        return frame[column][max(0, self._i - n + 1): self._i + 1]

    def submit(self, order: Order) -> None:
        if self.state.halted and order.origin == "strategy":
            self._reject(order, "HALTED")
        else:
            self.state.pending.append(order)

    def nav(self) -> float:
        """Value at the last closes."""
        s = self.state
        return s.book.cash + sum(h.shares * s.closes.get(x, h.price) * s.book.multipliers.get(x, 1.0) for x, h in s.book.holdings.items())

    # Rows.
    def _row(self, kind: str, **x) -> None:
        self.rows.append(tuple({"kind": kind, "at": self.now, **x}.get(c) for c in ROW))

    def _reject(self, order: Order, code: str, qty: float | None = None) -> None:
        self._row("rejection", symbol=order.symbol, side=order.side, qty=float(order.qty if qty is None else qty), code=code)

    def _trade(self, symbol: str, side: str, fill: Fill, pnl: float | None, multiplier: float = 1.0) -> None:
        self._row("trade", symbol=symbol, side=side, qty=float(fill.qty), price=fill.price, value=fill.qty * fill.price * multiplier, fees=fill.fees, cash=self.state.book.cash, pnl=pnl, closing=fill.closed > 0)

    # The fold.
    def run(self, bars: pd.DataFrame, ticks: Iterable[pd.Timestamp] | None = None) -> list[tuple]:
        """``bars``: symbol, date, open, close, pre_close, adj_factor (and what the strategy reads). Ticks before or at the last one seen only give history."""
        bars = bars.sort_values(["date", "symbol"], kind="stable")
        self._ticks = sorted(pd.Timestamp(t) for t in (bars["date"].unique() if ticks is None else ticks))
        place = {t: i for i, t in enumerate(self._ticks)}
        columns = [c for c in bars.columns if c not in ("symbol", "date") and pd.api.types.is_numeric_dtype(bars[c])]
        by_tick: dict[int, dict[str, dict]] = {}
        for symbol, g in bars.groupby("symbol", sort=False):
            at = [place[pd.Timestamp(t)] for t in g["date"]]
            self._frames[symbol] = {}
            for c in columns:
                full = np.full(len(self._ticks), np.nan)
                full[at] = g[c].to_numpy(dtype=float)
                self._frames[symbol][c] = full
            values = {c: g[c].to_numpy(dtype=float) for c in columns}
            for k, i in enumerate(at):
                by_tick.setdefault(i, {})[symbol] = {c: v[k] for c, v in values.items()}
            if (spec := contract_of(symbol)) is not None:
                self.state.book.multipliers[symbol] = spec.multiplier
        ctx = Context(self)
        ctx.params = self.strategy.params
        self.strategy.setup(ctx)
        since = pd.Timestamp(self.state.last) if self.state.last else None
        live = [i for i, t in enumerate(self._ticks) if since is None or t > since]
        for k, i in enumerate(live):
            self._i, self.now = i, self._ticks[i]
            closes_day = k + 1 == len(live) or self._ticks[live[k + 1]].date() != self.now.date()
            self._tick(ctx, by_tick.get(i, {}), closes_day)
            self.state.last = str(self.now)
        if live:
            self.strategy.on_stop(ctx)
            if not self.settings.carry_pending:
                for o in self.state.pending:
                    self._reject(o, "NO_MORE_BARS")
                self.state.pending.clear()
        return self.rows

    def _tick(self, ctx: Context, today: Mapping[str, dict], closes_day: bool) -> None:
        s, book = self.state, self.state.book
        new_day = s.day != str(self.now.date())
        if new_day:
            s.day, s.opened_today = str(self.now.date()), {}
            book.release()
        self._actions(today)
        if not self.settings.intraday:
            self._expire(today)
        if self.settings.execution == "next_open":
            self._fill_all(today, "open")
            self._mark(today)
            self._nav()
            self._hooks(ctx, new_day, closes_day)
        else:
            self._mark(today)
            self._hooks(ctx, new_day, closes_day)
            self._fill_all(today, "close")
            self._nav()

    def _hooks(self, ctx: Context, new_day: bool, closes_day: bool) -> None:
        times = self.settings.trigger_times
        if new_day:
            self.strategy.on_market_open(ctx)
        if not self.settings.intraday or not times or self.now.strftime("%H:%M") in times:
            self.strategy.on_signal(ctx)
        if closes_day:
            self.strategy.on_market_close(ctx)

    def _actions(self, today: Mapping[str, dict]) -> None:
        for symbol, bar in today.items():
            f = bar.get("adj_factor", np.nan)
            if np.isnan(f) or f <= 0:
                continue
            before = self.state.factors.get(symbol)
            if before is not None and abs(f / before - 1) > 1e-9 and abs(held := self.state.book.of(symbol).shares) > 1e-9:
                self.state.book.split(symbol, f / before)
                self._row("action", symbol=symbol, qty=held, value=f / before)
            self.state.factors[symbol] = f

    def _expire(self, today: Mapping[str, dict]) -> None:
        for symbol in list(self.state.book.holdings):
            spec, end = contract_of(symbol), expiry_of(symbol) if contract_of(symbol) else None
            if spec is None or end is None or self.now.date() < end:
                continue
            h = self.state.book.of(symbol)
            side = "sell" if h.shares > 0 else "buy"
            if symbol in today:
                self.state.pending.append(Order(symbol, side, abs(h.shares), "expiry"))
            else:
                qty, price = abs(h.shares), h.price
                pnl = self.state.book.trade(symbol, -h.shares, price, 0.0)
                self._trade(symbol, side, Fill(qty, price, 0.0, 0.0, qty), pnl, spec.multiplier)

    def _mark(self, today: Mapping[str, dict]) -> None:
        for symbol, bar in today.items():
            if not np.isnan(bar["close"]):
                self.state.closes[symbol] = bar["close"]
                if symbol in self.state.book.holdings:
                    self.state.book.holdings[symbol].price = bar["close"]

    def _nav(self) -> None:
        s = self.state
        nav = self.nav()
        self._row("nav", value=nav, cash=s.book.cash)
        s.peak = max(s.peak, nav)
        limit = self.settings.halt
        if limit is not None and not s.halted and s.peak > 0 and (s.peak - nav) / s.peak > limit:
            s.halted = True
            for symbol, h in s.book.holdings.items():
                s.pending.append(Order(symbol, "sell" if h.shares > 0 else "buy", abs(h.shares), "liquidate"))

    def _fill_all(self, today: Mapping[str, dict], at: str) -> None:
        queue, self.state.pending = self.state.pending, []
        for order in queue:
            bar = today.get(order.symbol)
            if bar is None or np.isnan(bar[at]):
                self._reject(order, "SUSPENDED")
                continue
            before = bar.get("pre_close", np.nan)
            before = bar["close"] if np.isnan(before) else before
            spec = contract_of(order.symbol)
            if spec is not None:
                self._fill_futures(order, spec, bar[at], before)
            else:
                self._fill_stock(order, bar[at], before)

    def _fill_stock(self, order: Order, ref: float, before: float) -> None:
        s, book, cap = self.settings, self.state.book, self.settings.weight_cap
        qty = order.qty
        if order.side == "buy" and cap is not None and ref > 0:
            room = max(0.0, cap * self.nav() - abs(book.of(order.symbol).shares) * ref) / ref
            if room < qty:
                self._reject(order, "WEIGHT_CAP", qty - room)
                qty = room
                if qty <= 0:
                    return
        fill = stock_fill(order.side, qty, ref, before, limit=board_limit(order.symbol), free=book.of(order.symbol).free, cash=book.cash, lot=s.lot, costs=s.costs)
        if fill.rejected:
            self._reject(order, fill.rejected, qty)
        elif order.side == "buy":
            book.buy(order.symbol, fill, same_day(order.symbol))
            self._trade(order.symbol, "buy", fill, None)
        else:
            pnl = book.sell(order.symbol, fill)
            self._trade(order.symbol, "sell", fill, pnl)

    def _headroom(self, symbol: str, ref: float) -> float:
        """Value less margin in use, plus that of the symbol itself, which the order may release."""
        book = self.state.book
        used = sum(abs(book.value(x)) * c.margin for x in book.holdings if (c := contract_of(x)) is not None)
        own = contract_of(symbol)
        return self.nav() - used + abs(book.of(symbol).shares) * ref * own.multiplier * own.margin

    def _fill_futures(self, order: Order, spec: Contract, ref: float, before: float) -> None:
        s, book = self.state, self.state.book
        end = expiry_of(order.symbol)
        if order.origin == "strategy" and end is not None and self.now.date() >= end:
            self._reject(order, "EXPIRED")
            return
        fill = futures_fill(order.side, order.qty, ref, before, contract=spec, held=book.of(order.symbol).shares, opened_today=s.opened_today.get(order.symbol, 0.0), headroom=self._headroom(order.symbol, ref), costs=self.settings.costs)
        if fill.rejected:
            self._reject(order, fill.rejected)
            return
        pnl = book.trade(order.symbol, fill.qty if order.side == "buy" else -fill.qty, fill.price, fill.fees)
        s.opened_today[order.symbol] = max(s.opened_today.get(order.symbol, 0.0) + fill.opened - fill.closed_today, 0.0)
        self._trade(order.symbol, order.side, fill, pnl, spec.multiplier)


def simulate(bars: DataFrame, runs: DataFrame, make: Callable[[dict], tuple[Strategy, Settings]], *, universe: str = "universe") -> DataFrame:
    """Many portfolios at once. ``runs``: run_id, ``universe`` (a value of the bars' column of that name), params (JSON).

    Bars meet runs on the universe: a universe's bars are brought together once and all of its runs are folded over them, so that a sweep
    shuffles no copies; parallel over universes, sequential within one, as a portfolio is. Columns: run_id and those of the tagged rows.
    ``make`` gets the run's parameters.
    """
    need = [c for c in ("symbol", "date", "open", "high", "low", "close", "pre_close", "volume", "amount", "adj_factor") if c in bars.columns]
    theirs = runs.select("run_id", F.col(universe).alias("__v"), "params")

    def run(bars: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for run_id, params in zip(asked["run_id"], asked["params"]) if len(bars) else ():
            strategy, settings = make(json.loads(params))
            out = pd.DataFrame(Desk(strategy, settings).run(bars.drop(columns=["__u"])), columns=list(ROW))
            out.insert(0, "run_id", run_id)
            parts.append(out.astype({"qty": float, "price": float, "value": float, "fees": float, "cash": float, "pnl": float}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["run_id", *ROW])

    return bars.select(F.col(universe).alias("__u"), *need).groupBy("__u").cogroup(theirs.groupBy("__v")).applyInPandas(run, "run_id string, " + SCHEMA)


def sweep(bars: DataFrame, grid: list[dict], make: Callable[[dict], tuple[Strategy, Settings]], universes: DataFrame, universe: str = "universe") -> DataFrame:
    """Every parameter set on every universe; the grid is configuration, laid out by an explode on the universes."""
    texts = F.array(*[F.lit(json.dumps(p, sort_keys=True)) for p in grid])
    runs = universes.select(universe, F.posexplode(texts).alias("k", "params")).select(F.concat_ws("#", F.col(universe).cast("string"), F.col("k").cast("string")).alias("run_id"), universe, "params")
    return simulate(bars, runs, make, universe=universe)


def resume(text: str | None, strategy: Strategy, settings: Settings, bars: pd.DataFrame) -> tuple[str, list[tuple]]:
    """Go on from a saved state over the bars' new ticks; without new ticks nothing changes."""
    desk = Desk(strategy, settings, State.load(text) if text else None)
    rows = desk.run(bars)
    return desk.state.dump(), rows
