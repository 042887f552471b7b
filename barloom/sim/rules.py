"""What an order becomes: fills, fees and rejections, as pure functions of numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from barloom.functions import market as K

EDGE = 1e-6


@dataclass(frozen=True)
class Costs:
    commission: float = K.COMMISSION
    least: float = K.LEAST_COMMISSION
    stamp: float = K.STAMP
    transfer: float = K.TRANSFER
    slippage_bps: float = K.SLIPPAGE_BPS
    futures_open: float = K.FUTURES_OPEN
    futures_close: float = K.FUTURES_CLOSE
    futures_close_today: float = K.FUTURES_CLOSE_TODAY
    futures_slippage_bps: float = K.FUTURES_SLIPPAGE_BPS

    def price(self, ref: float, side: str, futures: bool = False) -> float:
        step = (self.futures_slippage_bps if futures else self.slippage_bps) / 1e4
        return ref * (1 + step if side == "buy" else 1 - step)

    def stock(self, value: float, side: str) -> float:
        if value <= 0:
            return 0.0
        return max(value * self.commission, self.least) + (value * self.stamp if side == "sell" else 0.0) + value * self.transfer

    def futures(self, opened: float, closed: float, closed_today: float) -> float:
        return opened * self.futures_open + max(closed - closed_today, 0.0) * self.futures_close + min(max(closed_today, 0.0), closed) * self.futures_close_today


FREE = Costs(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


@dataclass(frozen=True)
class Contract:
    multiplier: float
    margin: float
    limit: float


@dataclass
class Fill:
    qty: float = 0.0
    price: float = 0.0
    fees: float = 0.0
    opened: float = 0.0
    closed: float = 0.0
    closed_today: float = 0.0
    rejected: str | None = None


def cents(x: float) -> float:
    return math.floor(x * 100 + 0.5) / 100


def board_limit(symbol: str) -> float:
    code, _, place = symbol.partition(".")
    if place == "BJ":
        return 0.30
    return 0.20 if (place, code[:3]) in {("SH", "688"), ("SH", "689"), ("SZ", "300"), ("SZ", "301")} else 0.10


def same_day(symbol: str) -> bool:
    code, _, place = symbol.partition(".")
    if place in K.FUTURES_EXCHANGES:
        return True
    fund = (place == "SH" and code[:2] in ("50", "51", "56", "58")) or (place == "SZ" and code[:2] in ("15", "16", "18"))
    return fund and ((place == "SH" and code[:3] in K.SAME_DAY_SH_PREFIXES) or code in K.SAME_DAY_SZ_CODES)


def at_limit(side: str, ref: float, before: float, limit: float) -> str | None:
    if side == "buy" and ref >= cents(before * (1 + limit)) - EDGE:
        return "LIMIT_UP"
    if side == "sell" and ref <= cents(before * (1 - limit)) + EDGE:
        return "LIMIT_DOWN"
    return None


def affordable(qty: float, ref: float, cash: float, lot: float, costs: Costs) -> float:
    """The order if cash suffices; else an estimate by rates, less the lots by which that is still too much."""
    price = costs.price(ref, "buy")

    def short(n: float) -> float:
        return n * price + costs.stock(n * price, "buy") - cash - EDGE

    if short(qty) <= 0:
        return qty
    rates = 1 + costs.commission + costs.transfer + costs.slippage_bps / 1e4
    qty = min(qty, math.floor(cash / (ref * rates) / lot) * lot)
    if qty > 0 and (lack := short(qty)) > 0:
        qty -= lot * math.ceil(lack / (lot * price * (1 + costs.commission + costs.transfer)) - 1e-12)
        while qty > 0 and short(qty) > 0:
            qty -= lot
    return max(qty, 0.0)


def stock_fill(side: str, qty: float, ref: float, before: float, *, limit: float, free: float, cash: float, lot: float, costs: Costs) -> Fill:
    if code := at_limit(side, ref, before, limit):
        return Fill(rejected=code)
    if qty <= 0:
        return Fill(rejected="QTY_INVALID")
    if side == "sell":
        if qty > free + EDGE:
            return Fill(rejected="T_PLUS_ONE")
        qty = min(qty, free)
    else:
        qty = math.floor(qty / lot) * lot
        if qty <= 0:
            return Fill(rejected="LOT_TOO_SMALL")
        qty = affordable(qty, ref, cash, lot, costs)
        if qty <= 0:
            return Fill(rejected="INSUFFICIENT_CASH")
    price = costs.price(ref, side)
    return Fill(qty, price, costs.stock(qty * price, side), qty if side == "buy" else 0.0, qty if side == "sell" else 0.0)


def futures_fill(side: str, qty: float, ref: float, before: float, *, contract: Contract, held: float, opened_today: float, headroom: float | None, costs: Costs) -> Fill:
    """Whole lots; what closes the held side needs no margin, what opens must fit the headroom with all fees of the order."""
    if code := at_limit(side, ref, before, contract.limit):
        return Fill(rejected=code)
    lots = math.floor(qty)
    if lots <= 0:
        return Fill(rejected="LOT_TOO_SMALL")
    sign = 1 if side == "buy" else -1
    closed = min(lots, abs(held)) if held * sign < 0 else 0.0
    opened, today = lots - closed, min(closed, max(opened_today, 0.0))
    price = costs.price(ref, side, futures=True)
    lot_value = price * contract.multiplier
    if opened > 0 and headroom is not None:
        closing_fees = costs.futures(0.0, closed * lot_value, today * lot_value)
        need = ref * contract.multiplier * contract.margin + lot_value * costs.futures_open
        opened = max(0, min(opened, math.floor((headroom + EDGE - closing_fees) / need)))
        if opened <= 0 and closed <= 0:
            return Fill(rejected="INSUFFICIENT_MARGIN")
    done = opened + closed
    return Fill(done, price, costs.futures(opened * lot_value, closed * lot_value, today * lot_value), opened, closed, today if closed else 0.0)


@dataclass
class Holding:
    shares: float = 0.0
    free: float = 0.0
    cost: float = 0.0
    price: float = 0.0


@dataclass
class Book:
    """Cash and holdings. Futures are held signed, at full value: nav = cash + sum of shares x price x multiplier."""

    cash: float
    holdings: dict[str, Holding] = field(default_factory=dict)
    multipliers: dict[str, float] = field(default_factory=dict)

    def of(self, symbol: str) -> Holding:
        return self.holdings.get(symbol) or Holding()

    def value(self, symbol: str) -> float:
        h = self.of(symbol)
        return h.shares * h.price * self.multipliers.get(symbol, 1.0)

    def nav(self) -> float:
        return self.cash + sum(self.value(s) for s in self.holdings)

    def buy(self, symbol: str, fill: Fill, immediate: bool) -> None:
        h = self.holdings.setdefault(symbol, Holding())
        self.cash -= fill.qty * fill.price + fill.fees
        h.cost = (h.shares * h.cost + fill.qty * fill.price + fill.fees) / (h.shares + fill.qty)
        h.shares += fill.qty
        h.free += fill.qty if immediate else 0.0
        h.price = fill.price

    def sell(self, symbol: str, fill: Fill) -> float:
        h = self.holdings[symbol]
        pnl = (fill.price - h.cost) * fill.qty - fill.fees
        self.cash += fill.qty * fill.price - fill.fees
        h.shares, h.free, h.price = h.shares - fill.qty, h.free - fill.qty, fill.price
        if h.shares <= 1e-9:
            del self.holdings[symbol]
        return pnl

    def trade(self, symbol: str, change: float, price: float, fees: float) -> float:
        """A futures trade: gain on what it closes; what it opens sets the cost anew."""
        if abs(change) < 1e-12:
            return 0.0
        m, h = self.multipliers.get(symbol, 1.0), self.holdings.setdefault(symbol, Holding())
        closed = min(abs(change), abs(h.shares)) if h.shares * change < 0 else 0.0
        gain = (price - h.cost) * (1 if h.shares > 0 else -1) * closed * m
        self.cash -= change * price * m + fees
        left = h.shares + change
        if abs(left) < 1e-9:
            del self.holdings[symbol]
        else:
            if abs(change) - closed > 1e-9:
                h.cost = price
            h.shares, h.free, h.price = left, left, price
        return gain - fees

    def split(self, symbol: str, ratio: float) -> None:
        """Shares times the ratio, cost by it; short holdings stay."""
        h = self.holdings.get(symbol)
        if h and h.shares > 0 and ratio > 0:
            h.shares, h.free, h.cost = h.shares * ratio, h.free * ratio, h.cost / ratio

    def release(self) -> None:
        for h in self.holdings.values():
            h.free = h.shares
