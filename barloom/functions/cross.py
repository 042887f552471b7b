"""Cross-sectional operators: Column expressions over the rows of one date (or any other key)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, functions as F

from barloom.functions.clean import ratio
from barloom.functions.series import EPSILON


def rank_average(x: Column, by: Sequence[str], ascending: bool = True) -> Column:
    """Rank of present values, ties sharing the mean of their ranks; NULL stays NULL."""
    group = Window.partitionBy(*by, x.isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    rank = F.rank().over(group.orderBy(x if ascending else x.desc()))
    return F.when(x.isNotNull(), rank + (ties - 1) / 2)


def rank_pct(x: Column, by: Sequence[str], ascending: bool = True) -> Column:
    return rank_average(x, by, ascending) / F.count(x).over(Window.partitionBy(*by))


def quantile_group(pct: Column, q: int) -> Column:
    return F.least(F.greatest(F.ceil(pct * q), F.lit(1)), F.lit(q)).cast("int")


def winsorize_quantile(x: Column, by: Sequence[str], low: float = 0.01, high: float = 0.99) -> Column:
    w = Window.partitionBy(*by)
    clipped = F.least(F.greatest(x, F.percentile(x, F.lit(low)).over(w)), F.percentile(x, F.lit(high)).over(w))
    return F.when(x.isNotNull(), clipped)


def zscore(x: Column, by: Sequence[str], sample: bool = False) -> Column:
    """(x - mean) / deviation; NULL where the deviation is nil."""
    w = Window.partitionBy(*by)
    spread = (F.stddev_samp if sample else F.stddev_pop)(x).over(w)
    return F.when(spread > EPSILON, (x - F.avg(x).over(w)) / spread)


def demean(x: Column, by: Sequence[str]) -> Column:
    return x - F.avg(x).over(Window.partitionBy(*by))


def residual(y: Column, x: Column, by: Sequence[str]) -> Column:
    """Residual of y on x with intercept; NULL for the whole group if x is missing next to a y, or there are no more than two rows."""
    w = Window.partitionBy(*by)
    x = F.when(y.isNotNull(), x)
    n = F.count(y).over(w)
    mx, my = F.avg(x).over(w), F.avg(y).over(w)
    slope = ratio(F.covar_pop(x, y).over(w), F.var_pop(x).over(w))
    fitted = my + F.coalesce(slope, F.lit(0.0)) * (x - mx)
    return F.when((n > 2) & (F.count(x).over(w) == n), y - fitted)


def guarded_corr(a: Column, b: Column, least: int = 3) -> Column:
    """Aggregate: Pearson correlation, NULL under ``least`` rows or without spread on a side."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= least) & (sa >= EPSILON) & (sb >= EPSILON), F.try_divide(F.covar_pop(a, b), sa * sb))
