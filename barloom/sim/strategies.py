"""Shipped strategies."""

from __future__ import annotations

import numpy as np

from barloom.sim.desk import Context, Strategy


class BuyAndHold(Strategy):
    """All of the target share into each symbol on the first signal."""

    def setup(self, ctx: Context) -> None:
        self.done = False

    def on_signal(self, ctx: Context) -> None:
        if not self.done:
            self.done = True
            symbols = self.params["symbols"]
            for s in symbols:
                ctx.order_target_percent(s, self.params.get("share", 1.0) / len(symbols))


def mean_of(values: np.ndarray, n: int) -> float:
    return float(values[-n:].mean()) if len(values) >= n and not np.isnan(values[-n:]).any() else np.nan


class DualMA(Strategy):
    """In while the fast mean of closes is above the slow one."""

    def on_signal(self, ctx: Context) -> None:
        fast, slow = self.params.get("fast", 5), self.params.get("slow", 20)
        for s in self.params["symbols"]:
            x = ctx.history(s, slow)
            a, b = mean_of(x, fast), mean_of(x, slow)
            if np.isnan(a) or np.isnan(b):
                continue
            held = ctx.position(s).shares > 0
            if a > b and not held:
                ctx.order_target_percent(s, self.params.get("share", 0.95) / len(self.params["symbols"]))
            elif a < b and held:
                ctx.order_target_percent(s, 0.0)


class MaTiming(Strategy):
    """In above the long mean, out below; sales are queued before purchases, for their cash."""

    def on_signal(self, ctx: Context) -> None:
        n, wanted = self.params.get("n", 200), {}
        symbols = self.params["symbols"]
        for s in symbols:
            m, p = mean_of(ctx.history(s, n), n), ctx.price(s)
            if not np.isnan(m) and p is not None:
                wanted[s] = (1.0 / len(symbols)) * self.params.get("share", 0.95) if p > m else 0.0
        for s in sorted(wanted, key=lambda x: wanted[x] - ctx.position(x).shares * (ctx.price(x) or 0) / max(ctx.total_value, 1e-9)):
            ctx.order_target_percent(s, wanted[s])


class DualMomentum(Strategy):
    """On the first signal of a month, all into the symbol with the greatest return over n ticks if that is positive."""

    def setup(self, ctx: Context) -> None:
        self.month = None

    def on_signal(self, ctx: Context) -> None:
        if self.month == (ctx.now.year, ctx.now.month):
            return
        self.month = (ctx.now.year, ctx.now.month)
        n = self.params.get("n", 60)
        gains = {}
        for s in self.params["symbols"]:
            x = ctx.history(s, n + 1)
            if len(x) == n + 1 and x[0] > 0 and not np.isnan(x[-1]):
                gains[s] = x[-1] / x[0] - 1
        best = max(gains, key=lambda s: (gains[s], s), default=None)
        for s in self.params["symbols"]:
            if ctx.position(s).shares > 0 and (s != best or gains[best] <= 0):
                ctx.order_target_percent(s, 0.0)
        if best is not None and gains[best] > 0 and ctx.position(best).shares == 0:
            ctx.order_target_percent(best, self.params.get("share", 0.95))


class VolMaTiming(MaTiming):
    """MaTiming with each share scaled down to a target volatility."""

    def on_signal(self, ctx: Context) -> None:
        n, m = self.params.get("n", 200), self.params.get("window", 20)
        for s in self.params["symbols"]:
            x = ctx.history(s, max(n, m + 1))
            mean, p = mean_of(x, n), ctx.price(s)
            if np.isnan(mean) or p is None or len(x) < m + 1:
                continue
            r = np.diff(x[-m - 1:]) / x[-m - 1:-1]
            vol = float(np.std(r, ddof=1) * np.sqrt(252))
            scale = min(1.0, self.params.get("target_vol", 0.15) / vol) if vol > 1e-12 else 1.0
            ctx.order_target_percent(s, 0.95 * scale / len(self.params["symbols"]) if p > mean else 0.0)


class FuturesShort(Strategy):
    """Short some lots on the first signal and hold."""

    def setup(self, ctx: Context) -> None:
        self.done = False

    def on_signal(self, ctx: Context) -> None:
        if not self.done:
            self.done = True
            for s in self.params["symbols"]:
                ctx.order(s, -self.params.get("lots", 1))


class DualMASymmetric(Strategy):
    """Futures: long above, short below, turning in one order."""

    def on_signal(self, ctx: Context) -> None:
        fast, slow, lots = self.params.get("fast", 5), self.params.get("slow", 20), self.params.get("lots", 1)
        for s in self.params["symbols"]:
            x = ctx.history(s, slow)
            a, b = mean_of(x, fast), mean_of(x, slow)
            if not (np.isnan(a) or np.isnan(b)) and a != b:
                ctx.order(s, (lots if a > b else -lots) - ctx.position(s).shares)


SHIPPED = {c.__name__: c for c in (BuyAndHold, DualMA, MaTiming, DualMomentum, VolMaTiming, FuturesShort, DualMASymmetric)}
