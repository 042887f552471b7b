"""Factor evaluation: rank correlation, layers, spreads, autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import cross as X
from barloom.functions.clean import ratio
from barloom.functions.series import EPSILON

YEAR = 252


def forward(x: Column, h: int, by: str = "symbol", order: str = "date") -> Column:
    """Return over the next h rows."""
    return ratio(F.lead(x, h).over(Window.partitionBy(by).orderBy(order)), x) - 1


def rank_ic(values: DataFrame, value: str = "value", fwd: str = "fwd") -> DataFrame:
    """(date, rank_ic, n): Spearman correlation of value and forward return per date; dates with under 3 pairs or no spread are left out."""
    pairs = values.where(F.col(value).isNotNull() & F.col(fwd).isNotNull())
    ranked = pairs.select("date", X.rank_average(F.col(value), ["date"]).alias("a"), X.rank_average(F.col(fwd), ["date"]).alias("b"))
    return ranked.groupBy("date").agg(X.guarded_corr(F.col("a"), F.col("b")).alias("rank_ic"), F.count(F.lit(1)).alias("n")).where("rank_ic is not null")


def ic_summary(ic: DataFrame) -> DataFrame:
    """Mean, deviation, ratio, t and share of positive days of a daily correlation."""
    s = F.coalesce(F.stddev_samp("rank_ic"), F.lit(0.0))
    base = ic.agg(F.avg("rank_ic").alias("ic_mean"), s.alias("ic_std"), F.count("rank_ic").alias("n_days"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_ratio"))
    ir = F.when(F.col("ic_std") > EPSILON, ratio(F.col("ic_mean"), F.col("ic_std"))).otherwise(0.0)
    return base.select("ic_mean", "ic_std", ir.alias("ic_ir"), (ir * F.sqrt("n_days")).alias("ic_t_stat"), "n_days", "positive_ratio")


def layers(values: DataFrame, q: int = 5, min_stocks: int = 10, value: str = "value") -> DataFrame:
    """Rows with their quantile group (``grp``) on dates with at least ``min_stocks`` values."""
    there = values.where(F.col(value).isNotNull()).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("date"))).where(F.col("__n") >= min_stocks).drop("__n")
    return there.withColumn("grp", X.quantile_group(X.rank_pct(F.col(value), ["date"]), q))


def layer_returns(grouped: DataFrame, fwd: str = "fwd") -> DataFrame:
    return grouped.groupBy("date", "grp").agg(F.avg(fwd).alias("ret")).where("ret is not null")


def long_short(returns: DataFrame, q: int) -> DataFrame:
    """Return of the top layer less that of the bottom layer, on dates with both."""
    top, bottom = F.max(F.when(F.col("grp") == q, F.col("ret"))), F.max(F.when(F.col("grp") == 1, F.col("ret")))
    return returns.groupBy("date").agg((top - bottom).alias("ret")).where("ret is not null")


def performance(returns: DataFrame, *by: str, ret: str = "ret") -> DataFrame:
    """Total and annual return and Sharpe ratio of periodic returns."""
    std = F.coalesce(F.stddev_samp(ret), F.lit(0.0))
    base = returns.groupBy(*by).agg((F.product(1 + F.col(ret)) - 1).alias("total_return"), F.count(ret).alias("n"), F.avg(ret).alias("__m"), std.alias("__s"))
    annual = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), F.lit(float(YEAR)) / F.col("n")) - 1)
    sharpe = F.when(F.col("__s") > EPSILON, ratio(F.col("__m"), F.col("__s")) * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0)
    return base.select(*by, "total_return", annual.alias("annual_return"), sharpe.alias("sharpe"), "n")


def group_autocorrelation(grouped: DataFrame) -> DataFrame:
    """(date, autocorr): rank correlation of the groups of a date with those of the date with groups before it."""
    # a date's place among the dates with groups: one row per date
    dates = grouped.select("date").distinct().withColumn("__o", F.row_number().over(Window.orderBy("date")))
    placed = grouped.join(dates, "date").select("symbol", "date", "grp", "__o")
    before = placed.select(F.col("symbol").alias("__s"), (F.col("__o") + 1).alias("__p"), F.col("grp").alias("__g"))
    both = placed.join(before, (F.col("symbol") == F.col("__s")) & (F.col("__o") == F.col("__p")))
    ranked = both.select("date", X.rank_average(F.col("grp").cast("double"), ["date"]).alias("a"), X.rank_average(F.col("__g").cast("double"), ["date"]).alias("b"))
    return ranked.groupBy("date").agg(X.guarded_corr(F.col("a"), F.col("b")).alias("autocorr")).where("autocorr is not null")
