"""Technical indicators as Column expressions over one ordered window per symbol.

``line`` is the ordered window (partition by symbol, order by date). Rolling results are NULL until n present values are in the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F
from pyspark.sql.window import WindowSpec

from barloom.functions.clean import ratio

EPSILON = 1e-12


def line(*by: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling(aggregate, x: Column, n: int, w: WindowSpec) -> Column:
    """``aggregate`` over the last n rows, where all n values are present."""
    frame = last_n(w, n)
    return F.when(F.count(x).over(frame) == n, aggregate(x).over(frame))


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    return rolling(F.avg, x, n, w)


def ref(x: Column, n: int, w: WindowSpec) -> Column:
    return F.lag(x, n).over(w)


def diff(x: Column, n: int, w: WindowSpec) -> Column:
    return x - ref(x, n, w)


def hhv(x: Column, n: int, w: WindowSpec) -> Column:
    return rolling(F.max, x, n, w)


def llv(x: Column, n: int, w: WindowSpec) -> Column:
    return rolling(F.min, x, n, w)


def deviation(x: Column, n: int, w: WindowSpec) -> Column:
    """Sample standard deviation of the last n values."""
    return rolling(F.stddev_samp, x, n, w)


def cross(a: Column, b: Column, w: WindowSpec) -> Column:
    """a was at or under b and is now above; FALSE where anything is missing."""
    return F.coalesce((a > b) & (F.lag(a).over(w) <= F.lag(b).over(w)), F.lit(False))


def cross_down(a: Column, b: Column, w: WindowSpec) -> Column:
    return F.coalesce((a < b) & (F.lag(a).over(w) >= F.lag(b).over(w)), F.lit(False))


def roc(x: Column, n: int, w: WindowSpec) -> Column:
    return ratio(x, ref(x, n, w)) - 1


def bias(x: Column, n: int, w: WindowSpec) -> Column:
    return ratio(x, sma(x, n, w)) - 1


def boll(x: Column, n: int, k: float, w: WindowSpec) -> tuple[Column, Column, Column]:
    """Middle, upper and lower band."""
    middle, width = sma(x, n, w), k * deviation(x, n, w)
    return middle, middle + width, middle - width


def true_range(high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    before = F.lag(close).over(w)
    # greatest() passes over the missing close before the first row
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def rsv(high: Column, low: Column, close: Column, n: int, w: WindowSpec) -> Column:
    """Place of the close in the range of n rows, in percent; NULL in a flat range."""
    bottom = llv(low, n, w)
    return ratio(close - bottom, hhv(high, n, w) - bottom) * 100


def zscore(x: Column, n: int, w: WindowSpec) -> Column:
    return ratio(x - sma(x, n, w), deviation(x, n, w))


def fill_forward(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def change(x: Column, w: WindowSpec) -> Column:
    """Change to the last present value before, over gaps; 0 on a gap once there was a value."""
    filled = fill_forward(x, w)
    before = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ratio(filled, before) - 1


def growth(r: Column, w: WindowSpec) -> Column:
    """Running product of 1 + r, missing returns counting as 0."""
    return F.product(1 + F.coalesce(r, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(nav: Column, w: WindowSpec) -> Column:
    return ratio(nav, F.max(nav).over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1


def step_product(r: Column, w: WindowSpec) -> Column:
    """Piecewise-constant factor: running product of event ratios, missing ones counting as 1."""
    return F.product(F.coalesce(r, F.lit(1.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def roll_factor(close: Column, threshold: float, w: WindowSpec) -> Column:
    """Continuous-contract factor: each move of more than the threshold between neighbours is taken as a roll and undone."""
    before = F.lag(close).over(w)
    jump = F.when((before > 0) & (F.abs(ratio(close, before) - 1) > threshold), ratio(before, close))
    return step_product(jump, w)


def run_id(flag: Column, w: WindowSpec) -> Column:
    """Flag changed since the row before (1/0); its running sum numbers the runs."""
    return F.when(flag.eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)
