"""Set-based backtests: weights from factors, portfolio returns, drifted weights, timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import cross as X, series as S
from barloom.functions.clean import ratio
from barloom.operators import panel as P


def weights_from_factor(values: DataFrame, value: str = "value", *, top: float = 0.2, bottom: float = 0.2, gross: float = 1.0, min_stocks: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, date, weight, and the columns to ``keep``): the top share long, the bottom share short, each equally, absolute weights adding up to ``gross``.

    NULL for names in neither leg and on dates with too few values; a name in both legs is short.
    """
    if not 0 < top <= 1 or not 0 <= bottom <= 1 or top + bottom > 1:
        raise ValueError("top in (0, 1], bottom in [0, 1], together at most 1")
    day = Window.partitionBy("date")
    pct = values.select("symbol", "date", *keep, X.rank_pct(F.col(value), ["date"]).alias("pct"), F.count(value).over(day).alias("n"))
    legs = pct.select("symbol", "date", *keep, "n", (F.coalesce(F.col("pct") >= 1 - top, F.lit(False))).alias("up"), (F.coalesce(F.col("pct") <= bottom, F.lit(False))).alias("down"))
    ups, downs = F.count_if("up").over(day), F.count_if("down").over(day)
    total = (ups > 0).cast("int") + (downs > 0).cast("int")
    raw = F.when(F.col("down"), -ratio(F.lit(1.0), downs)).when(F.col("up"), ratio(F.lit(1.0), ups))
    return legs.select("symbol", "date", *keep, F.when(F.col("n") >= min_stocks, raw * (ratio(F.lit(gross), total) if gross > 0 else F.lit(1.0))).alias("weight"))


def portfolio(weights: DataFrame, prices: DataFrame | None = None, *, price: str = "h", fee_rate: float = 1.5e-4, lag: int = 1) -> DataFrame:
    """(date, gross, turnover, net, nav). Weights decided at a close act on the return ``lag`` dates later; missing weights are 0.

    ``prices`` is a dense panel; without it, ``weights`` is one that has the price too, and no join is needed. Returns bridge gaps. Only the daily sums go through the final single-partition product: a row per date.
    """
    if lag < 1 or fee_rate < 0:
        raise ValueError("lag is at least 1 and fee_rate not negative")
    w = S.line("symbol")
    if prices is None:
        joined = weights.select("symbol", "date", F.col(price).alias("p"), "weight")
    else:
        joined = prices.select("symbol", "date", F.col(price).alias("p")).join(weights.select("symbol", "date", "weight"), ["symbol", "date"], "left")
    held = joined.select("symbol", "date", F.coalesce(F.lag("weight", lag).over(w), F.lit(0.0)).alias("w"), S.change(F.col("p"), w).alias("r"))
    moved = held.select("date", "w", "r", F.abs(F.col("w") - F.lag("w").over(w)).alias("dw"))
    daily = moved.groupBy("date").agg(F.coalesce(F.sum(F.col("w") * F.col("r")), F.lit(0.0)).alias("gross"), (F.coalesce(F.sum("dw"), F.lit(0.0)) / 2).alias("turnover"))
    daily = daily.withColumn("net", F.col("gross") - F.col("turnover") * fee_rate)
    return daily.withColumn("nav", F.product(1 + F.col("net")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def portfolio_on_rows(weights: DataFrame, dates: DataFrame, *, price: str = "h", fee_rate: float = 1.5e-4, lag: int = 1) -> DataFrame:
    """As ``portfolio``, from bars alone: ``weights`` has symbol, ord, weight and the price of each bar, ``dates`` all dates with their ord.

    A weight is held from ``lag`` dates on until the next date; where there is no bar then, it is given up at that date. Nothing is
    multiplied out to symbols by dates.
    """
    if lag < 1 or fee_rate < 0:
        raise ValueError("lag is at least 1 and fee_rate not negative")
    w = Window.partitionBy("symbol").orderBy("ord")
    held, mine = F.coalesce("weight", F.lit(0.0)), F.col("weight")
    rows = weights.select("ord", held.alias("w"), F.coalesce(P.at(mine, -lag), F.lit(0.0)).alias("was"), F.coalesce(P.at(mine, -1), F.lit(0.0)).alias("before"), P.at(F.col("ord"), 1).isNull().alias("ends"), S.change(F.col(price), w).alias("r"))
    part = lambda o, g, d: F.struct(o.alias("ord"), g.alias("g"), d.alias("d"))
    none = F.lit(None).cast("double")
    parts = F.array(part(F.col("ord"), F.col("was") * F.col("r"), none), part(F.col("ord") + lag, none, F.abs(F.col("w") - F.col("before"))), F.when(F.col("ends"), part(F.col("ord") + lag + 1, none, F.abs(F.col("w")))))
    daily = rows.select(F.explode(parts).alias("x")).where("x is not null").groupBy(F.col("x.ord").alias("__o")).agg(F.sum("x.g").alias("g"), F.sum("x.d").alias("d"))
    every = dates.join(daily, F.col("ord") == F.col("__o"), "left").select("date", F.coalesce("g", F.lit(0.0)).alias("gross"), (F.coalesce("d", F.lit(0.0)) / 2).alias("turnover"))
    every = every.withColumn("net", F.col("gross") - F.col("turnover") * fee_rate)
    return every.withColumn("nav", F.product(1 + F.col("net")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def rebalance_days(dates: DataFrame, every: str | int) -> DataFrame:
    """First date of each month or week, or every k-th date; one row per date."""
    if every in ("month", "week"):
        return dates.groupBy(F.date_trunc(every, F.col("date")).alias("__p")).agg(F.min("date").alias("date")).select("date")
    return dates.withColumn("__o", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("__o") % int(every) == 0).select("date")


def hold_top(values: DataFrame, days: DataFrame, n: int, value: str = "value") -> DataFrame:
    """(symbol, date, weight) on every date of the dense ``values``: the n best of the last rebalance day with enough values, equally; else 0.

    Ties go to the lower symbol.
    """
    at = values.join(days.withColumn("__r", F.lit(True)), "date", "left")
    day = Window.partitionBy("date")
    ok = F.coalesce(F.col("__r"), F.lit(False)) & (F.count(value).over(day) >= n)
    place = F.row_number().over(day.orderBy(F.col(value).desc_nulls_last(), F.col("symbol")))
    target = at.select("symbol", "date", F.when(ok, F.when((place <= n) & F.col(value).isNotNull(), 1.0 / n).otherwise(0.0)).alias("t"))
    return target.select("symbol", "date", F.coalesce(S.fill_forward(F.col("t"), S.line("symbol")), F.lit(0.0)).alias("weight"))


def drifted(weights: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """Weights set on rebalance days, drifting with returns in between: w is proportional to the set weight times growth since then.

    ``weights``: symbol, date, target (NULL except on rebalance days). ``returns``: symbol, date, ret on the same dense grid; a missing
    return counts as 0; without ``returns``, ``weights`` has ``ret`` too. Growth of a day acts from the next date on. Dates before the first rebalance have weight 0.
    """
    w = S.line("symbol")
    joined = weights if returns is None else returns.select("symbol", "date", "ret").join(weights.select("symbol", "date", "target"), ["symbol", "date"], "left")
    both = joined.select("symbol", "date", F.coalesce("ret", F.lit(0.0)).alias("r"), "target")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    spans = both.select("symbol", "date", "target", F.lag("r", 1, 0.0).over(w).alias("before"), F.count("target").over(upto).alias("span"))
    span = Window.partitionBy("symbol", "span").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = spans.select("symbol", "date", "span", F.first("target").over(span).alias("t"), F.product(F.when(F.col("target").isNotNull(), 1.0).otherwise(1 + F.col("before"))).over(span).alias("g"))
    part = F.when(F.col("span") > 0, F.col("t") * F.col("g"))
    return grown.select("symbol", "date", F.coalesce(ratio(part, F.sum(part).over(Window.partitionBy("date"))), F.lit(0.0)).alias("weight"))


def timing(signal: DataFrame, by: str, *, fee: float = 5e-4) -> DataFrame:
    """Per ``by``: full or no position by yesterday's signal > 0, costs on changes; growth, drawdown, share of time, switches.

    ``signal``: by, date, sig, ret. Annual rates go by calendar days.
    """
    w = Window.partitionBy(by).orderBy("date")
    pos = F.coalesce(F.lag((F.col("sig") > 0).cast("double")).over(w), F.lit(0.0))
    held = signal.select(by, "date", pos.alias("pos"), F.coalesce("ret", F.lit(0.0)).alias("r"))
    moved = held.withColumn("dp", F.coalesce(F.abs(F.col("pos") - F.lag("pos").over(w)), F.lit(0.0))).withColumn("net", F.col("pos") * F.col("r") - F.col("dp") * fee)
    navs = moved.withColumns({"nav": S.growth(F.col("net"), w), "bh": S.growth(F.col("r"), w)}).withColumns({"dd": S.drawdown(F.col("nav"), w), "bdd": S.drawdown(F.col("bh"), w)})
    years = F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(1e-9))

    def annual(x: str) -> Column:
        return F.pow(F.max_by(x, "date"), 1 / years) - 1

    return navs.groupBy(by).agg(annual("nav").alias("annual"), F.min("dd").alias("max_dd"), F.avg("pos").alias("position_ratio"), annual("bh").alias("bh_annual"), F.min("bdd").alias("bh_max_dd"), F.count_if(F.col("dp") > 0).alias("n_switches"))
