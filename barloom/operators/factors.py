"""Factor library over a dense panel; a factor maps the panel to one Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import series as S
from barloom.functions.clean import ratio
from barloom.operators.panel import hfq

#: A factor gets named columns of the panel (h: adjusted close, ret: change over gaps, and the raw fields) and the symbol's window.
Factor = Callable[..., Column]
_REGISTRY: dict[str, tuple[Factor, dict]] = {}


def register(name: str, **params) -> Callable[[Factor], Factor]:
    def add(f: Factor) -> Factor:
        if name in _REGISTRY:
            raise ValueError(f"factor {name} exists")
        _REGISTRY[name] = (f, params)
        return f

    return add


def names() -> list[str]:
    return sorted(_REGISTRY)


def prepare(panel: DataFrame) -> DataFrame:
    """Adds ``h`` (adjusted close) and ``ret`` (its change over gaps)."""
    w = S.line("symbol")
    with_h = panel.withColumn("h", hfq())
    return with_h.withColumn("ret", S.change(F.col("h"), w))


def compute(panel: DataFrame, wanted: list[str | tuple[str, str, dict]]) -> DataFrame:
    """Symbol, date and one column per factor, all over one window. Entries: a name, or (column, name, parameters)."""
    ready, w = prepare(panel), S.line("symbol")
    out = []
    for x in wanted:
        column, name, given = (x, x, {}) if isinstance(x, str) else x
        if name not in _REGISTRY:
            raise KeyError(f"unknown factor {name}; there are {', '.join(names())}")
        f, params = _REGISTRY[name]
        out.append(f(w, **(params | given)).alias(column))
    return ready.select("symbol", "date", *out)


@register("Mom", n=20)
def momentum(w, n: int) -> Column:
    return S.roc(F.col("h"), n, w)


@register("Reversal", n=5)
def reversal(w, n: int) -> Column:
    return -S.roc(F.col("h"), n, w)


@register("Volatility", n=20)
def volatility(w, n: int) -> Column:
    return S.deviation(F.col("ret"), n, w)


@register("Illiq", n=20)
def illiquidity(w, n: int) -> Column:
    return S.sma(ratio(F.abs("ret"), F.col("amount")) * 1e9, n, w)


@register("VWAPDev")
def vwap_deviation(w) -> Column:
    return ratio(F.col("close"), F.when(F.col("volume") > 0, ratio(F.col("amount"), F.col("volume") * 100))) - 1


@register("AtrRatio", n=14)
def atr_ratio(w, n: int) -> Column:
    factor = F.coalesce("adj_factor", F.lit(1.0))
    return ratio(S.sma(S.true_range(F.col("high") * factor, F.col("low") * factor, F.col("h"), w), n, w), F.col("h"))


@register("LowVolatility", n=20)
def low_volatility(w, n: int) -> Column:
    return -S.deviation(F.col("ret"), n, w)


@register("Amplitude", n=20)
def amplitude(w, n: int) -> Column:
    return -S.sma(ratio(F.col("high"), F.col("low")) - 1, n, w)


@register("Turnover", n=20)
def turnover(w, n: int) -> Column:
    return -S.sma(F.col("turnover_rate"), n, w)
