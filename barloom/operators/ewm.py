"""Recursive indicators: one grouped pass per symbol for all of them."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.functions.series import EPSILON

#: name -> (kind, parameters). Kinds: ema(n), ewm(alpha), macd(fast, slow, signal), rsi(n), kdj(n, m).
Spec = Mapping[str, tuple]

OUTPUTS = {"ema": ("",), "ewm": ("",), "macd": ("_dif", "_dea", "_hist"), "rsi": ("",), "kdj": ("_k", "_d", "_j")}


def smooth(x: pd.Series, alpha: float) -> pd.Series:
    """y = alpha x + (1 - alpha) y', seeded by the first value; over gaps the old weight decays by their length."""
    return x.ewm(alpha=alpha, adjust=False).mean()


def _one(pdf: pd.DataFrame, kind: str, args: tuple, column: str) -> list[pd.Series]:
    x = pdf[column]
    if kind == "ema":
        return [smooth(x, 2 / (args[0] + 1))]
    if kind == "ewm":
        return [smooth(x, args[0])]
    if kind == "macd":
        fast, slow, signal = args
        dif = smooth(x, 2 / (fast + 1)) - smooth(x, 2 / (slow + 1))
        dea = smooth(dif, 2 / (signal + 1))
        return [dif, dea, 2 * (dif - dea)]
    if kind == "rsi":
        step = x.diff()
        up, all_ = smooth(step.clip(lower=0), 1 / args[0]), smooth(step.abs(), 1 / args[0])
        flat = all_ <= EPSILON
        return [(up / all_ * 100).mask(flat, 100.0).mask(flat & (up <= EPSILON), 50.0)]
    if kind == "kdj":
        n, m = args
        low, high = pdf["low"].rolling(n, min_periods=n).min(), pdf["high"].rolling(n, min_periods=n).max()
        place = ((pdf["close"] - low) / (high - low) * 100).where(high > low)
        k = smooth(place, 1 / m)
        d = smooth(k, 1 / m)
        return [k, d, 3 * k - 2 * d]
    raise ValueError(f"unknown kind {kind}")


def recursive(df: DataFrame, specs: Spec, *, by: str = "symbol", order: str = "date", column: str = "close") -> DataFrame:
    """``by``, ``order`` and one column per output of each spec. A group is one symbol's history, bounded by the calendar."""
    need = dict.fromkeys([by, order, column, *(["high", "low", "close"] if any(k == "kdj" for k, *_ in specs.values()) else [])])
    names = [f"{n}{suffix}" for n, (kind, *_) in specs.items() for suffix in OUTPUTS[kind]]
    schema = StructType([df.schema[by], df.schema[order], *[StructField(n, DoubleType()) for n in names]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        out = pdf[[by, order]].copy()
        for name, (kind, *args) in specs.items():
            for suffix, values in zip(OUTPUTS[kind], _one(pdf, kind, tuple(args), column)):
                out[f"{name}{suffix}"] = values.to_numpy()
        return out

    done = df.select(*need).groupBy(by).applyInPandas(run, schema)
    return done.select(by, order, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
