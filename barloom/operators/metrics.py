"""Performance measures of net-asset-value series, many series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import series as S
from barloom.functions.clean import ratio
from barloom.functions.series import EPSILON

YEAR = 252.0


def returns(nav: DataFrame, by: Sequence[str], value: str = "nav") -> DataFrame:
    """``ret`` (NULL on the first row) and ``dd`` (drawdown) next to each value."""
    w = Window.partitionBy(*by).orderBy("date")
    return nav.where(F.col(value).isNotNull()).withColumns({"ret": ratio(F.col(value), F.lag(value).over(w)) - 1, "dd": S.drawdown(F.col(value), w)})


def sortino(ret: Column) -> Column:
    risk = F.sqrt(F.avg(F.pow(F.least(ret, F.lit(0.0)), F.lit(2.0)))) * F.sqrt(F.lit(YEAR))
    return F.when(risk > EPSILON, ratio(F.avg(ret) * YEAR, risk)).otherwise(0.0)


def summarize(nav: DataFrame, by: Sequence[str], value: str = "nav") -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, drawdown, Calmar and share of winning days; zeros under two values."""
    r = returns(nav, by, value)
    a = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(value, "date").alias("__first"), F.max_by(value, "date").alias("__last"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("__s"),
        F.avg("ret").alias("__m"), F.min("dd").alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("daily_win_rate"), sortino(F.col("ret")).alias("sortino"),
    )
    total = ratio(F.col("__last"), F.col("__first")) - 1
    annual = F.when((F.col("n") > 1) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), F.lit(YEAR) / (F.col("n") - 1)) - 1).otherwise(0.0)
    a = a.withColumn("total_return", F.coalesce(total, F.lit(0.0))).withColumn("annual_return", annual)
    sharpe = F.when(F.col("__s") > EPSILON, ratio(F.col("__m"), F.col("__s")) * F.sqrt(F.lit(YEAR))).otherwise(0.0)
    calmar = F.when(F.abs("max_drawdown") > EPSILON, ratio(F.col("annual_return"), F.abs("max_drawdown"))).otherwise(0.0)
    return a.select(*by, "n", "total_return", "annual_return", (F.col("__s") * F.sqrt(F.lit(YEAR))).alias("annual_vol"), sharpe.alias("sharpe"), F.coalesce("sortino", F.lit(0.0)).alias("sortino"), "max_drawdown", calmar.alias("calmar"), F.coalesce("daily_win_rate", F.lit(0.0)).alias("daily_win_rate"))


def streaks(nav: DataFrame, by: Sequence[str], value: str = "nav") -> DataFrame:
    """Longest runs of winning and of losing days; a day without change ends a run."""
    w = Window.partitionBy(*by).orderBy("date")
    r = returns(nav, by, value).where("ret is not null").withColumn("__sign", F.signum("ret"))
    runs = r.withColumn("__new", S.run_id(F.col("__sign"), w)).withColumn("__run", F.sum("__new").over(w))
    counted = runs.groupBy(*by, "__run").agg(F.first("__sign").alias("__sign"), F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("__sign") > 0, F.col("__n"))), F.lit(0)).alias("max_win_days"), F.coalesce(F.max(F.when(F.col("__sign") < 0, F.col("__n"))), F.lit(0)).alias("max_loss_days"))


def alpha_beta(nav: DataFrame, benchmark: DataFrame, by: Sequence[str], value: str = "nav", bench: str = "bench") -> DataFrame:
    """Beta = covariance over variance of daily returns on common days; alpha = yearly mean return beyond it."""
    r = returns(nav, by, value).where("ret is not null").select(*by, "date", "ret")
    b = benchmark.where(F.col(bench).isNotNull()).withColumn("rb", ratio(F.col(bench), F.lag(bench).over(Window.orderBy("date"))) - 1).where("rb is not null").select("date", "rb")
    m = r.join(b, "date").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_samp("ret", "rb").alias("c"), F.var_samp("rb").alias("v"), F.avg("ret").alias("mr"), F.avg("rb").alias("mb"))
    beta = F.when((F.col("n") > 1) & (F.col("v") > EPSILON), ratio(F.col("c"), F.col("v"))).otherwise(0.0)
    return m.select(*by, F.when(F.col("n") > 1, (F.col("mr") - beta * F.col("mb")) * YEAR).otherwise(0.0).alias("alpha"), beta.alias("beta"), "n")


def period_returns(nav: DataFrame, by: Sequence[str], period: Column, value: str = "nav") -> DataFrame:
    """Compound return per ``period`` (a month, a year); the first return of a series counts as nil."""
    r = returns(nav, by, value)
    return r.groupBy(*by, period.alias("period")).agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"))


def trade_stats(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, fees, win rate, profit factor, best and worst of closing trades. profit_factor is infinite without losses."""
    closed = F.col("closing") & F.col("pnl").isNotNull()
    gains = F.coalesce(F.sum(F.when(closed & (F.col("pnl") > 0), F.col("pnl"))), F.lit(0.0))
    losses = F.coalesce(-F.sum(F.when(closed & (F.col("pnl") < 0), F.col("pnl"))), F.lit(0.0))
    factor = F.when(losses > EPSILON, F.try_divide(gains, losses)).when(gains > 0, F.lit(float("inf"))).otherwise(0.0)
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"), F.sum("fees").alias("total_fees"), F.avg(F.when(closed, (F.col("pnl") > 0).cast("double"))).alias("trade_win_rate"), factor.alias("profit_factor"), F.max(F.when(closed, F.col("pnl"))).alias("max_single_win"), F.min(F.when(closed, F.col("pnl"))).alias("max_single_loss"), F.sum("value").alias("traded"))
