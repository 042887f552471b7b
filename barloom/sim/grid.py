"""Folds over one series: grid trading and step-cleaned factors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ANCHOR, FEE, LEVELS = 60, 5e-4, 25


def grid_nav(prices: np.ndarray, step: float, most: int, fee: float = FEE) -> np.ndarray:
    """Value of a ladder of units: one is sold per level risen and bought per level fallen; levels are laid anew every ANCHOR ticks around the median."""
    out = np.zeros(len(prices))
    if not len(prices):
        return out
    cash, units, last, ladder = most * prices[0], 0, None, None
    for i, p in enumerate(prices):
        if i == 0 or i % ANCHOR == 0:
            anchor = prices[0] if i == 0 else float(np.median(prices[i - ANCHOR:i]))
            ladder, last = np.log(anchor) + np.arange(-LEVELS, LEVELS + 1) * np.log1p(step), None
        level = int(np.argmin(np.abs(ladder - np.log(p))))
        moves = 0 if last is None else level - last
        for _ in range(abs(moves)):
            if moves < 0 and units < most and cash >= p * (1 + fee):
                cash, units = cash - p * (1 + fee), units + 1
            elif moves > 0 and units > 0:
                cash, units = cash + p * (1 - fee), units - 1
        last, out[i] = level, cash + units * p
    return out / (most * prices[0])


def step_clean(factor: np.ndarray, least: float = 0.005) -> np.ndarray:
    """Keeps a value until one differs from the last kept by more than ``least``; missing ones repeat it."""
    out, kept = np.full(len(factor), np.nan), np.nan
    for i, f in enumerate(factor):
        if not np.isnan(f) and (np.isnan(kept) or abs(f / kept - 1) > least):
            kept = f
        out[i] = kept
    return out


def grid_trading(bars: DataFrame, step: float, most: int, price: str = "close") -> DataFrame:
    """(symbol, date, nav) per symbol; prices of zero or less are passed over."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        return pdf[["symbol", "date"]].assign(nav=grid_nav(pdf[price].to_numpy(dtype=float), step, most))

    return bars.where(f"{price} > 0").select("symbol", "date", price).groupBy("symbol").applyInPandas(run, "symbol string, date date, nav double")


def clean_factors(bars: DataFrame, least: float = 0.005) -> DataFrame:
    """(symbol, date, factor) with small steps removed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        return pdf[["symbol", "date"]].assign(factor=step_clean(pdf["adj_factor"].to_numpy(dtype=float), least))

    return bars.select("symbol", "date", "adj_factor").groupBy("symbol").applyInPandas(run, "symbol string, date date, factor double")
