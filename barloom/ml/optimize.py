"""Portfolio weights from expected returns and covariances; small dense problems, solved in numpy, or larger ones through a factor."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy

import numpy as np

#: Columns of a factor that are kept over the same rows.
TOGETHER = 256


def onto_simplex(v: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Nearest point with entries in [low, high] that add up to 1."""
    a, z = v.min() - high, v.max() - low
    for _ in range(100):
        mid = (a + z) / 2
        a, z = (mid, z) if np.clip(v - mid, low, high).sum() > 1 else (a, mid)
    w = np.clip(v - (a + z) / 2, low, high)
    free = (w > low) & (w < high)
    if free.any():
        w[free] += (1 - w.sum()) / free.sum()
    return w


class Factored:
    """Covariance z'z + ridge I of the columns of z, kept as z: memory and products grow with the columns, not their square.

    Columns that start at about the same row are kept together over the rows they span, so that rows before and after cost nothing.
    """

    def __init__(self, z: np.ndarray, ridge: float = 0.0):
        z = np.asarray(z, dtype=float)
        self._set([np.arange(z.shape[0])] * z.shape[1], list(z.T), z.shape[0], ridge)

    @classmethod
    def of_columns(cls, rows: Sequence[np.ndarray], values: Sequence[np.ndarray], height: int, ridge: float = 0.0) -> "Factored":
        """From the rows and values of each column of z; a row comes once in a column, and no column is empty."""
        self = cls.__new__(cls)
        self._set(rows, values, height, ridge)
        return self

    def _set(self, rows: Sequence[np.ndarray], values: Sequence[np.ndarray], height: int, ridge: float) -> None:
        self.height, self.width, self.ridge, self.scale, self.blocks, self._square = height, len(rows), ridge, 1.0, [], None
        order = np.argsort([x.min() for x in rows], kind="stable")
        for at in range(0, len(order), TOGETHER):
            own = order[at : at + TOGETHER]
            lo, hi = min(int(rows[k].min()) for k in own), max(int(rows[k].max()) for k in own) + 1
            x = np.zeros((len(own), hi - lo))
            for i, k in enumerate(own):
                x[i, rows[k] - lo] = values[k]
            self.blocks.append((own, slice(lo, hi), x))

    def __len__(self) -> int:
        return self.width

    def through(self, w: np.ndarray) -> np.ndarray:
        """zw"""
        out = np.zeros(self.height)
        for own, span, x in self.blocks:
            out[span] += w[own] @ x
        return out

    def back(self, p: np.ndarray) -> np.ndarray:
        """z'p"""
        out = np.empty(self.width)
        for own, span, x in self.blocks:
            out[own] = x @ p[span]
        return out

    def gram(self, h: np.ndarray) -> np.ndarray:
        """z diag(h) z', for h of zero or more."""
        out = np.zeros((self.height, self.height))
        for own, span, x in self.blocks:
            x = x * np.sqrt(h[own])[:, None]
            out[span, span] += x.T @ x
        return out

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return self.scale * (self.back(self.through(w)) + self.ridge * w)

    def __rmul__(self, c: float) -> "Factored":
        out = copy(self)
        out.scale = c * self.scale
        return out

    def largest(self) -> float:
        """Largest eigenvalue."""
        return self.scale * (float(np.linalg.eigvalsh(self.gram(np.ones(self.width)))[-1]) + self.ridge)

    def _inverse(self, d: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """v to (z'z + diag d)^-1 v, by a matrix as large as z has columns or rows, whichever are fewer."""
        if self.width <= self.height:
            if self._square is None:
                z = np.zeros((self.width, self.height))
                for own, span, x in self.blocks:
                    z[own, span] = x
                self._square = z @ z.T
            whole = np.linalg.inv(self._square + np.diag(d))
            return lambda v: whole @ v
        small = np.linalg.inv(np.eye(self.height) + self.gram(1 / d))
        return lambda v: (v - self.back(small @ self.through(v / d))) / d

    def _solver(self, d: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """The same, refined once."""
        once = self._inverse(d)

        def solve(v: np.ndarray) -> np.ndarray:
            x = once(v)
            return x + once(v - self.back(self.through(x)) - d * x)

        return solve

    def risk_parity(self, tolerance: float = 1e-10, most: int = 500) -> np.ndarray:
        """Equal contributions to risk: least of x'Sx / 2 - sum(log x) by Newton steps, which needs no positive covariances, scaled to 1."""
        own = np.empty(self.width)
        for mine, _, x in self.blocks:
            own[mine] = np.einsum("ij,ij->i", x, x) + self.ridge
        x = 1 / np.sqrt(own * self.width)
        s = copy(self)
        s.scale = 1.0  # which a sum of 1 takes out
        sx = s @ x
        for _ in range(most):
            slope = sx - 1 / x
            step = -self._solver(self.ridge + 1 / x**2)(slope)
            along, decrement = s @ step, max(float(-slope @ step), 0.0)
            t = min(1.0, 0.95 / max(np.max(-step / x), 1e-300))
            # the change of the function itself: the difference of two values would lose it
            while decrement > 1e-6 and t > 1e-12 and t * (sx @ step) + t * t / 2 * (step @ along) - np.log1p(t * step / x).sum() > -0.1 * t * decrement:
                t /= 2
            new = x + t * step
            sx = s @ new
            done, x = np.max(np.abs(new / new.sum() - x / x.sum())) < tolerance, new
            if done:
                break
        return x / x.sum()

    def quadratic(self, linear: np.ndarray, tolerance: float = 1e-8, most: int = 100) -> np.ndarray:
        """Least of w'Sw / 2 - linear'w over the simplex, for a ridge above 0, by interior points with predictor and corrector.

        The number of steps hardly depends on the size. The gap between the bounds on the least value tells how far off weights can be at
        most, as the ridge makes the function strongly convex: that has to be below the tolerance, or weights no longer change.
        """
        n = self.width
        w = np.full(n, 1 / n)
        slope = self @ w - linear
        y = slope.min() - np.ptp(slope) - self.scale * self.ridge
        s = slope - y
        for _ in range(most):
            off, total = self @ w - linear - y - s, w.sum() - 1
            solve = self._solver(self.ridge + s / (self.scale * w))
            ones = solve(np.ones(n)) / self.scale

            def step(product: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
                g = solve(-off - product / w) / self.scale
                dy = (-total - g.sum()) / ones.sum()
                dw = g + dy * ones
                return dw, dy, -(product + s * dw) / w

            def longest(dw: np.ndarray, ds: np.ndarray) -> float:
                return min(1.0, 1 / max(np.max(-dw / w), np.max(-ds / s), 1e-300))

            dw, dy, ds = step(w * s)
            t = longest(dw, ds)
            gap = w @ s
            aim = ((w + t * dw) @ (s + t * ds) / gap) ** 3 * gap / n
            dw, dy, ds = step(w * s + dw * ds - aim)
            t = 0.995 * longest(dw, ds)
            w, y, s = w + t * dw, y + t * dy, s + t * ds
            if np.sqrt(2 * (w @ s) / (self.scale * self.ridge)) < tolerance or t * np.max(np.abs(dw)) < 1e-13:
                break
        return w / w.sum()


def _covariance(sigma: np.ndarray | Factored) -> np.ndarray | Factored:
    return sigma if isinstance(sigma, Factored) else np.asarray(sigma, dtype=float)


def quadratic(sigma: np.ndarray | Factored, linear: np.ndarray, long_only: bool = True, tolerance: float = 1e-13, most: int = 20_000) -> np.ndarray:
    """Least of w'Sw / 2 - linear'w over the simplex (or entries in [-1, 1]), by accelerated projected gradients.

    A long-only problem with a factor and a ridge is solved by interior points: gradients take too many steps where the ridge is small.
    """
    if isinstance(sigma, Factored) and long_only and sigma.ridge > 0:
        return sigma.quadratic(np.asarray(linear, dtype=float))
    n, low = len(linear), 0.0 if long_only else -1.0
    pace = 1 / max(sigma.largest() if isinstance(sigma, Factored) else float(np.linalg.eigvalsh(sigma)[-1]), 1e-18)
    w = y = np.full(n, 1 / n)
    t = 1.0
    for _ in range(most):
        new = onto_simplex(y - pace * (sigma @ y - linear), low)
        if (y - new) @ (new - w) > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - w)
        done, w, t = np.max(np.abs(new - w)) < tolerance, new, after
        if done:
            break
    return w


def min_variance(sigma: np.ndarray | Factored, long_only: bool = True) -> np.ndarray:
    sigma = _covariance(sigma)
    return quadratic(2 * sigma, np.zeros(len(sigma)), long_only)


def mean_variance(mu: np.ndarray, sigma: np.ndarray | Factored, aversion: float = 2.0, long_only: bool = True) -> np.ndarray:
    return quadratic(aversion * _covariance(sigma), np.asarray(mu, dtype=float), long_only)


def risk_parity(sigma: np.ndarray, tolerance: float = 1e-10, most: int = 500) -> np.ndarray:
    """Fixed point of w proportional to 1 / (Sw): equal contributions to risk.

    Each step goes to the geometric mean of the weights and their image, as the plain iteration alternates where correlations are low.
    """
    sigma = np.asarray(sigma, dtype=float)
    w = np.full(len(sigma), 1 / len(sigma))
    for _ in range(most):
        new = np.sqrt(w / (sigma @ w))
        new = new / new.sum()
        if np.max(np.abs(new - w)) < tolerance:
            break
        w = new
    return w
