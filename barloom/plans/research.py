"""Queries of cross-section, factor evaluation, performance measures and set-based backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.functions import cross as X, series as S
from barloom.functions.clean import ratio
from barloom.operators import analysis as A, factors, metrics as M, panel as P, vectorized as V
from barloom.operators.covariance import pairwise_covariance
from barloom.plans.base import D, W, bars, day, dense, lag, moves, q6, r6, rank_avg, rank_pct, roll, sql
from barloom.session import stage_table

QUERIES: dict = {}
SQL: dict = {}
FIELDS = ["open", "high", "low", "close", "volume", "amount", "turnover_rate", "adj_factor"]


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return add


# Cross-sections of the close and turnover of each date.
def T():
    return F.col("turnover_rate")


def C():
    return F.col("close")


def over_dates(name: str, column, text: str, *more: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return bars(spark, sf).select("symbol", day().alias("date"), column().alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = sql(f"SELECT symbol, {D}, {text} AS value FROM b", *more)


over_dates("x02_winsorize_quantile", lambda: r6(X.winsorize_quantile(T(), ["date"])), q6("CASE WHEN turnover_rate IS NOT NULL THEN least(greatest(turnover_rate, quantile_cont(turnover_rate, 0.01) OVER (PARTITION BY d)), quantile_cont(turnover_rate, 0.99) OVER (PARTITION BY d)) END"))
over_dates("x03_zscore", lambda: r6(X.zscore(T(), ["date"])), q6("CASE WHEN stddev_pop(turnover_rate) OVER (PARTITION BY d) > 1e-12 THEN (turnover_rate - avg(turnover_rate) OVER (PARTITION BY d)) / stddev_pop(turnover_rate) OVER (PARTITION BY d) END"))
over_dates("x04_rank_pct", lambda: r6(X.rank_pct(T(), ["date"])), q6(rank_pct("turnover_rate", "d")))
over_dates("x06_quantile_group", lambda: X.quantile_group(X.rank_pct(T(), ["date"]), 5), f"least(greatest(ceil(({rank_pct('turnover_rate', 'd')}) * 5), 1), 5)::INT")
over_dates("x10_composite", lambda: r6((X.rank_pct(T(), ["date"]) + X.rank_pct(C(), ["date"])) / 2), q6(f"(({rank_pct('turnover_rate', 'd')}) + ({rank_pct('close', 'd')})) / 2"))
over_dates("x11_demean", lambda: F.round(X.demean(T(), ["date"]), 10) + F.lit(0.0), "round(turnover_rate - avg(turnover_rate) OVER (PARTITION BY d), 10) + 0.0")
over_dates("x12_standardize", lambda: r6(X.zscore(T(), ["date"], sample=True)), q6("CASE WHEN stddev_samp(turnover_rate) OVER (PARTITION BY d) > 1e-12 THEN (turnover_rate - avg(turnover_rate) OVER (PARTITION BY d)) / stddev_samp(turnover_rate) OVER (PARTITION BY d) END"))
over_dates(
    "x05_neutralize", lambda: r6(X.residual(T(), F.log(F.when(F.col("amount") > 0, F.col("amount"))), ["date"])),
    q6("CASE WHEN count(turnover_rate) OVER w > 2 AND count(xx) OVER w = count(turnover_rate) OVER w THEN turnover_rate - avg(turnover_rate) OVER w - coalesce(covar_pop(turnover_rate, xx) OVER w / nullif(var_pop(xx) OVER w, 0), 0) * (xx - avg(xx) OVER w) END").replace("OVER w", "OVER (PARTITION BY d)"),
)
SQL["x05_neutralize"] = SQL["x05_neutralize"].replace("FROM b", "FROM (SELECT *, CASE WHEN turnover_rate IS NOT NULL AND amount > 0 THEN ln(amount) END AS xx FROM b) b2")
SQL["x05_neutralize"] = SQL["x05_neutralize"].replace("FROM (SELECT *, CASE WHEN turnover_rate IS NOT NULL AND amount > 0 THEN ln(amount) END AS xx FROM b) b2 WHERE rn", "FROM b WHERE rn")


@query("x01_winsorize_mad", sql(f"SELECT symbol, {D}, {q6('CASE WHEN x IS NULL THEN NULL WHEN mad > 0 THEN least(greatest(x, med - 3 * 1.4826 * mad), med + 3 * 1.4826 * mad) ELSE x END')} AS value FROM m2",
    "m AS (SELECT symbol, d, turnover_rate AS x, median(turnover_rate) OVER (PARTITION BY d) AS med FROM b)", "m2 AS (SELECT *, median(abs(x - med)) OVER (PARTITION BY d) AS mad FROM m)"))
def x01_winsorize_mad(spark: SparkSession, sf: str) -> DataFrame:
    """Clipped to three scaled median deviations around the median; no clipping where they are nil."""
    w = Window.partitionBy("date")
    m = bars(spark, sf).select("symbol", "date", T().alias("x")).withColumn("med", F.median("x").over(w)).withColumn("mad", F.median(F.abs(F.col("x") - F.col("med"))).over(w))
    width = 3 * 1.4826 * F.col("mad")
    clipped = F.when(F.col("x").isNotNull(), F.when(F.col("mad") > 0, F.least(F.greatest(F.col("x"), F.col("med") - width), F.col("med") + width)).otherwise(F.col("x")))
    return m.select("symbol", day().alias("date"), r6(clipped).alias("value"))


# Momentum on the dense panel, its forward return over one row.
MOM = f"m AS (SELECT symbol, d, h, ret, h / nullif({lag('h', 5)}, 0) - 1 AS value, lead(h) OVER ({W}) / nullif(h, 0) - 1 AS fwd FROM p)"
PAIRS = "pr AS (SELECT * FROM m WHERE value IS NOT NULL AND fwd IS NOT NULL)"
RANKED = f"rk AS (SELECT d, {rank_avg('value', 'd')} AS a, {rank_avg('fwd', 'd')} AS c FROM pr)"
IC = "ic AS (SELECT d, covar_pop(a, c) / nullif(stddev_pop(a) * stddev_pop(c), 0) AS rank_ic, count(*) AS n FROM rk GROUP BY d HAVING count(*) >= 3 AND stddev_pop(a) >= 1e-12 AND stddev_pop(c) >= 1e-12)"
GROUPED = f"gr AS (SELECT symbol, d, value, fwd, least(greatest(ceil(({rank_pct('value', 'd')}) * 5), 1), 5)::INT AS grp FROM (SELECT *, count(value) OVER (PARTITION BY d) AS n FROM m WHERE value IS NOT NULL) WHERE n >= 10)"
LAYERS = "ly AS (SELECT d, grp, avg(fwd) AS ret FROM gr GROUP BY ALL HAVING avg(fwd) IS NOT NULL)"


def momentum_panel(spark: SparkSession, sf: str) -> DataFrame:
    """h, ret, value and fwd over one window, without a join."""
    ready = factors.prepare(dense(spark, sf, FIELDS))
    w = S.line("symbol")
    return ready.select("symbol", "date", "h", "ret", S.roc(F.col("h"), 5, w).alias("value"), A.forward(F.col("h"), 1).alias("fwd"))


def momentum_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The same on the bars alone, with the place of their date (``ord``); and all dates with theirs."""
    rows, dates = P.on_dates(bars(spark, sf).select("symbol", "date", P.hfq().alias("h")))
    h = F.col("h")
    return rows.select("symbol", "date", "ord", "h", S.change(h, S.line("symbol", order="ord")).alias("ret"), (ratio(h, P.at(h, -5)) - 1).alias("value"), (ratio(P.at(h, 1), h) - 1).alias("fwd")), dates


@query("a01_rank_ic", sql(f"SELECT {D}, {q6('rank_ic')} AS rank_ic, n FROM ic", MOM, PAIRS, RANKED, IC, panel=True))
def a01_rank_ic(spark: SparkSession, sf: str) -> DataFrame:
    return A.rank_ic(momentum_rows(spark, sf)[0]).select(day().alias("date"), r6("rank_ic").alias("rank_ic"), "n")


@query("a02_ic_summary", sql(f"SELECT {q6('avg(rank_ic)')} AS ic_mean, {q6('stddev_samp(rank_ic)')} AS ic_std, {q6('avg(rank_ic) / stddev_samp(rank_ic)')} AS ic_ir, round(avg(rank_ic) / stddev_samp(rank_ic) * sqrt(count(*)), 5) AS ic_t_stat, count(*) AS n_days, {q6('avg((round(rank_ic, 10) > 0)::INT)')} AS positive_ratio FROM ic", MOM, PAIRS, RANKED, IC, panel=True))
def a02_ic_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = A.ic_summary(A.rank_ic(momentum_rows(spark, sf)[0]).withColumn("rank_ic", F.round("rank_ic", 10)))
    return s.select(r6("ic_mean").alias("ic_mean"), r6("ic_std").alias("ic_std"), r6("ic_ir").alias("ic_ir"), F.round("ic_t_stat", 5).alias("ic_t_stat"), "n_days", r6("positive_ratio").alias("positive_ratio"))


@query("a03_layers", sql(f"SELECT {D}, grp, {q6('ret')} AS ret FROM ly", MOM, GROUPED, LAYERS, panel=True))
def a03_layers(spark: SparkSession, sf: str) -> DataFrame:
    return A.layer_returns(A.layers(momentum_rows(spark, sf)[0])).select(day().alias("date"), "grp", r6("ret").alias("ret"))


@query("a04_long_short", sql(f"SELECT {D}, {q6('t.ret - l.ret')} AS ret FROM (SELECT d, ret FROM ly WHERE grp = 5) t JOIN (SELECT d, ret FROM ly WHERE grp = 1) l USING (d)", MOM, GROUPED, LAYERS, panel=True))
def a04_long_short(spark: SparkSession, sf: str) -> DataFrame:
    return A.long_short(A.layer_returns(A.layers(momentum_rows(spark, sf)[0])), 5).select(day().alias("date"), r6("ret").alias("ret"))


@query("a05_layer_performance", sql(f"SELECT grp, round(t, 4) AS total_return, round(CASE WHEN t > -1 THEN pow(1 + t, 252.0 / n) - 1 END, 4) AS annual_return, {q6('CASE WHEN s > 1e-12 THEN m / s * sqrt(252) ELSE 0 END')} AS sharpe, n FROM (SELECT grp, product(1 + ret) - 1 AS t, count(*) AS n, avg(ret) AS m, coalesce(stddev_samp(ret), 0) AS s FROM ly2 GROUP BY grp)", MOM, GROUPED, LAYERS, "ly2 AS (SELECT d, grp, greatest(least(ret, 0.1), -0.1) AS ret FROM ly)", panel=True))
def a05_layer_performance(spark: SparkSession, sf: str) -> DataFrame:
    """Performance of the layers, daily returns held to 10 % as the store has wrong prices."""
    held = A.layer_returns(A.layers(momentum_rows(spark, sf)[0])).withColumn("ret", F.greatest(F.least("ret", F.lit(0.1)), F.lit(-0.1)))
    return A.performance(held, "grp").select("grp", F.round("total_return", 4).alias("total_return"), F.round("annual_return", 4).alias("annual_return"), r6("sharpe").alias("sharpe"), "n")


@query("a06_group_autocorrelation", sql(
    f"SELECT {D}, {q6('covar_pop(a, c) / nullif(stddev_pop(a) * stddev_pop(c), 0)')} AS autocorr FROM rr GROUP BY d HAVING count(*) >= 3 AND stddev_pop(a) >= 1e-12 AND stddev_pop(c) >= 1e-12",
    MOM, GROUPED, "gd AS (SELECT d, row_number() OVER (ORDER BY d) AS o FROM (SELECT DISTINCT d FROM gr))", "bo AS (SELECT x.symbol, x.d, x.grp AS g1, y.grp AS g0 FROM gr x JOIN gd ON gd.d = x.d JOIN gd e ON e.o = gd.o - 1 JOIN gr y ON y.symbol = x.symbol AND y.d = e.d)",
    f"rr AS (SELECT d, {rank_avg('g1', 'd')} AS a, {rank_avg('g0', 'd')} AS c FROM bo)", panel=True))
def a06_group_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return A.group_autocorrelation(A.layers(momentum_rows(spark, sf)[0]).select("symbol", "date", "grp")).select(day().alias("date"), r6("autocorr").alias("autocorr"))


# Net asset values: growth of each symbol's daily moves, held to 30 % as the store has wrong prices.
NAV = f"nv AS (SELECT symbol, d, product(1 + coalesce(CASE WHEN close > 0 AND pre_close > 0 THEN greatest(least(close / pre_close - 1, 0.3), -0.3) END, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS nav FROM b)"
RET = f"rt AS (SELECT symbol, d, nav, nav / nullif({lag('nav')}, 0) - 1 AS ret, nav / nullif(max(nav) OVER ({W} ROWS UNBOUNDED PRECEDING), 0) - 1 AS dd FROM nv)"


def navs(spark: SparkSession, sf: str) -> DataFrame:
    move = F.when((C() > 0) & (F.col("pre_close") > 0), F.greatest(F.least(C() / F.col("pre_close") - 1, F.lit(0.3)), F.lit(-0.3)))
    return bars(spark, sf).select("symbol", "date", move.alias("r")).select("symbol", "date", S.growth(F.col("r"), S.line("symbol")).alias("nav"))


@query("a07_metrics", sql(
    f"SELECT symbol, n, {q6('tot')} AS total_return, round(ann, 4) AS annual_return, {q6('s * sqrt(252)')} AS annual_vol, {q6('CASE WHEN s > 1e-12 THEN m / s * sqrt(252) ELSE 0 END')} AS sharpe, {q6('CASE WHEN risk > 1e-12 THEN m * 252 / risk ELSE 0 END')} AS sortino, {q6('mdd')} AS max_drawdown, round(CASE WHEN abs(mdd) > 1e-12 THEN ann / abs(mdd) ELSE 0 END, 4) AS calmar, {q6('coalesce(win, 0)')} AS daily_win_rate FROM (SELECT *, CASE WHEN n > 1 AND tot > -1 THEN pow(1 + tot, 252.0 / (n - 1)) - 1 ELSE 0 END AS ann FROM ag)",
    NAV, RET, "ag AS (SELECT symbol, count(*) AS n, arg_max(nav, d) / nullif(arg_min(nav, d), 0) - 1 AS tot, coalesce(stddev_samp(ret), 0) AS s, avg(ret) AS m, min(dd) AS mdd, avg((round(ret, 10) > 0)::INT) AS win, sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252) AS risk FROM rt GROUP BY symbol)"))
def a07_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = M.summarize(navs(spark, sf), ["symbol"])
    return m.select("symbol", "n", *[(F.round(c, 4) if c in ("annual_return", "calmar") else r6(c)).alias(c) for c in m.columns[2:]])


@query("a09_streaks", sql("SELECT symbol, coalesce(max(n) FILTER (s > 0), 0) AS max_win_days, coalesce(max(n) FILTER (s < 0), 0) AS max_loss_days FROM (SELECT symbol, run, any_value(s) AS s, count(*) AS n FROM s3 GROUP BY ALL) GROUP BY symbol",
    NAV, RET, "s1 AS (SELECT symbol, d, sign(round(ret, 10)) AS s FROM rt WHERE ret IS NOT NULL)", f"s2 AS (SELECT *, CASE WHEN s = {lag('s')} THEN 0 ELSE 1 END AS new FROM s1)", f"s3 AS (SELECT *, sum(new) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM s2)"))
def a09_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return M.streaks(navs(spark, sf), ["symbol"])


BENCH = "bn AS (SELECT d, avg(nav) AS bench FROM nv GROUP BY d)"


@query("a11_benchmark", sql(f"SELECT {q6('arg_max(bench, d) / arg_min(bench, d) - 1')} AS benchmark_return, count(*) AS n FROM bn", NAV, BENCH))
def a11_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    bench = navs(spark, sf).groupBy("date").agg(F.avg("nav").alias("bench"))
    return bench.agg(r6(F.try_divide(F.max_by("bench", "date"), F.min_by("bench", "date")) - 1).alias("benchmark_return"), F.count(F.lit(1)).alias("n"))


@query("a12_alpha_beta", sql(f"SELECT symbol, {q6('CASE WHEN n > 1 THEN (mr - beta * mb) * 252 ELSE 0 END')} AS alpha, {q6('beta')} AS beta, n FROM (SELECT symbol, count(*) AS n, avg(ret) AS mr, avg(rb) AS mb, CASE WHEN count(*) > 1 AND var_samp(rb) > 1e-12 THEN covar_samp(ret, rb) / var_samp(rb) ELSE 0 END AS beta FROM rt JOIN (SELECT d, bench / lag(bench) OVER (ORDER BY d) - 1 AS rb FROM bn) USING (d) WHERE ret IS NOT NULL AND rb IS NOT NULL GROUP BY symbol)", NAV, RET, BENCH))
def a12_alpha_beta(spark: SparkSession, sf: str) -> DataFrame:
    nav = navs(spark, sf)
    bench = nav.groupBy("date").agg(F.avg("nav").alias("bench"))
    return M.alpha_beta(nav, bench, ["symbol"]).select("symbol", r6("alpha").alias("alpha"), r6("beta").alias("beta"), "n")


for _name, _fmt, _sql in (("a13_monthly_returns", "yyyy-MM", "%Y-%m"), ("a14_yearly_returns", "yyyy", "%Y")):
    def _run(spark: SparkSession, sf: str, fmt: str = _fmt) -> DataFrame:
        return M.period_returns(navs(spark, sf), ["symbol"], F.date_format("date", fmt)).select("symbol", "period", r6("ret").alias("ret"))

    QUERIES[_name] = _run
    SQL[_name] = sql(f"SELECT symbol, strftime(d, '{_sql}') AS period, {q6('product(1 + coalesce(ret, 0)) - 1')} AS ret FROM rt GROUP BY ALL", NAV, RET)


@query("a28_yearly_drawdown", sql(f"SELECT symbol, y, {q6('min(dd)')} AS max_drawdown FROM (SELECT symbol, year(d)::INT AS y, nav / nullif(max(nav) OVER (PARTITION BY symbol, year(d) ORDER BY d ROWS UNBOUNDED PRECEDING), 0) - 1 AS dd FROM nv) GROUP BY ALL", NAV))
def a28_yearly_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    nav = navs(spark, sf).withColumn("y", F.year("date"))
    return nav.withColumn("dd", S.drawdown(F.col("nav"), S.line("symbol", "y"))).groupBy("symbol", "y").agg(r6(F.min("dd")).alias("max_drawdown"))


@query("a25_split_mean", sql(f"SELECT symbol, {q6('CASE WHEN min(1 + ret) FILTER (y <= 2022) > 0 THEN pow(product(1 + ret) FILTER (y <= 2022), 1.0 / count(*) FILTER (y <= 2022)) - 1 END')} AS before_mean, {q6('CASE WHEN min(1 + ret) FILTER (y > 2022) > 0 THEN pow(product(1 + ret) FILTER (y > 2022), 1.0 / count(*) FILTER (y > 2022)) - 1 END')} AS after_mean FROM (SELECT symbol, year(d) AS y, product(1 + coalesce(ret, 0)) - 1 AS ret FROM rt GROUP BY ALL) GROUP BY symbol", NAV, RET))
def a25_split_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Geometric mean of yearly returns up to 2022 and after."""
    y = M.period_returns(navs(spark, sf), ["symbol"], F.year("date"))

    def mean(when) -> F.Column:
        g = F.when(when, 1 + F.col("ret"))
        return r6(F.when(F.min(g) > 0, F.pow(F.product(g), 1 / F.count(g)) - 1))

    return y.groupBy("symbol").agg(mean(F.col("period") <= 2022).alias("before_mean"), mean(F.col("period") > 2022).alias("after_mean"))


@query("a26_yearly_ic", sql(f"SELECT count(*) AS years, {q6('avg(m)')} AS mean_ic, {q6('min(m)')} AS min_ic, {q6('max(m)')} AS max_ic, count(*) FILTER (m > 0) AS positive_years FROM (SELECT year(d) AS y, avg(rank_ic) AS m FROM ic GROUP BY 1)", MOM, PAIRS, RANKED, IC, panel=True))
def a26_yearly_ic(spark: SparkSession, sf: str) -> DataFrame:
    y = A.rank_ic(momentum_rows(spark, sf)[0]).groupBy(F.year("date").alias("y")).agg(F.avg("rank_ic").alias("m"))
    return y.agg(F.count(F.lit(1)).alias("years"), r6(F.avg("m")).alias("mean_ic"), r6(F.min("m")).alias("min_ic"), r6(F.max("m")).alias("max_ic"), F.count_if(F.col("m") > 0).alias("positive_years"))


@query("a19_breadth", sql(
    f"SELECT {D}, count(*) FILTER (up) AS limit_up_n, {q6('count(*) FILTER (ret > 0) * 1.0 / nullif(count(ret), 0)')} AS up_ratio, {q6('median(ret)')} AS med_ret, {q6('count(*) FILTER (high20) * 1.0 / nullif(count(close), 0)')} AS new_high_20, round(sum(amount), 0) AS amount FROM m GROUP BY d",
    f"m AS (SELECT symbol, d, close, amount, close / nullif(pre_close, 0) - 1 AS ret, coalesce(close >= pre_close * (1 + CASE WHEN symbol LIKE '%.BJ' THEN 0.3 WHEN symbol SIMILAR TO '(688|689).*SH' OR symbol SIMILAR TO '(300|301).*SZ' THEN 0.2 ELSE 0.1 END) * 0.998 AND close = high, false) AS up, coalesce(close >= {roll('max', 20, 'close')}, false) AS high20 FROM b)"))
def a19_breadth(spark: SparkSession, sf: str) -> DataFrame:
    """Limit-ups, share of gainers, median return, 20-day highs and turnover of each day."""
    from barloom.functions.market import limit_ratio

    df = bars(spark, sf).select(
        "date", "close", "amount", (F.try_divide(C(), F.col("pre_close")) - 1).alias("ret"),
        F.coalesce((C() >= F.col("pre_close") * (1 + limit_ratio(F.col("symbol"))) * 0.998) & (C() == F.col("high")), F.lit(False)).alias("up"),
        F.coalesce(C() >= S.hhv(C(), 20, S.line("symbol")), F.lit(False)).alias("high20"),
    )
    return df.groupBy("date").agg(F.count_if("up").alias("limit_up_n"), r6(F.try_divide(F.count_if(F.col("ret") > 0), F.count("ret"))).alias("up_ratio"), r6(F.median("ret")).alias("med_ret"), r6(F.try_divide(F.count_if("high20"), F.count("close"))).alias("new_high_20"), F.round(F.sum("amount"), 0).alias("amount")).withColumn("date", day())


@query("a20_covariance", sql("SELECT x.symbol AS sym_a, y.symbol AS sym_b, round(covar_samp(x.r, y.r), 8) + 0.0 AS cov, count(*) AS n FROM m x JOIN m y ON x.d = y.d AND x.symbol <= y.symbol GROUP BY ALL HAVING count(*) >= 20",
    "m AS (SELECT symbol, d, greatest(least(close / pre_close - 1, 0.3), -0.3) AS r FROM b WHERE close > 0 AND pre_close > 0)"))
def a20_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """Covariance of the daily moves of symbols over their common days; 20 at least."""
    return pairwise_covariance(moves(spark, sf), 20)


# Backtests on the momentum factor.
WEIGHTS = f"""wt AS (SELECT symbol, d, CASE WHEN n >= 3 THEN CASE WHEN down THEN -1.0 / downs WHEN up THEN 1.0 / ups END / ((ups > 0)::INT + (downs > 0)::INT) END AS weight FROM (
    SELECT *, count(*) FILTER (up) OVER (PARTITION BY d) AS ups, count(*) FILTER (down) OVER (PARTITION BY d) AS downs FROM (
    SELECT symbol, d, n, coalesce(pct >= 0.8, false) AS up, coalesce(pct <= 0.2, false) AS down FROM (SELECT symbol, d, {rank_pct('value', 'd')} AS pct, count(value) OVER (PARTITION BY d) AS n FROM m))))"""


def _backtest(l: int) -> tuple[str, ...]:
    return (
        f"hd AS (SELECT m.symbol, m.d, coalesce(lag(wt.weight, {l}) OVER (PARTITION BY m.symbol ORDER BY m.d), 0) AS w, CASE WHEN m.ret IS NOT NULL THEN greatest(least(m.ret, 0.3), -0.3) END AS r FROM m LEFT JOIN wt ON wt.symbol = m.symbol AND wt.d = m.d)",
        f"mv AS (SELECT *, abs(w - {lag('w')}) AS dw FROM hd)",
        "dy AS (SELECT d, coalesce(sum(w * r), 0) AS gross, coalesce(sum(dw), 0) / 2 AS turnover FROM mv GROUP BY d)",
        "bt AS (SELECT d, gross, turnover, gross - turnover * 0.00015 AS net, product(1 + gross - turnover * 0.00015) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS nav FROM dy)",
    )


def held_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Weights and held prices on the bars alone, and all dates."""
    rows, dates = momentum_rows(spark, sf)
    p = rows.select("symbol", "date", "ord", "value", F.when(F.col("ret").isNotNull(), F.greatest(F.least("ret", F.lit(0.3)), F.lit(-0.3))).alias("r"))
    p = p.select("symbol", "date", "ord", "value", S.growth(F.col("r"), S.line("symbol", order="ord")).alias("h"))
    return V.weights_from_factor(p, keep=("ord", "h")), dates


def held_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Dense prices whose daily changes are held to 30 %: growth of the held changes."""
    w = S.line("symbol")
    p = momentum_panel(spark, sf).select("symbol", "date", "value", F.when(F.col("ret").isNotNull(), F.greatest(F.least("ret", F.lit(0.3)), F.lit(-0.3))).alias("r"))
    return p.select("symbol", "date", "value", S.growth(F.col("r"), w).alias("h"), "r")


@query("x07_weights", sql(f"SELECT symbol, {D}, {q6('weight')} AS weight FROM wt WHERE weight IS NOT NULL", MOM, WEIGHTS, panel=True))
def x07_weights(spark: SparkSession, sf: str) -> DataFrame:
    return V.weights_from_factor(momentum_rows(spark, sf)[0]).where("weight is not null").select("symbol", day().alias("date"), r6("weight").alias("weight"))


for _name, _lag in (("b01_backtest", 1), ("b01_backtest_lag3", 3)):
    def _bt(spark: SparkSession, sf: str, lag: int = _lag) -> DataFrame:
        d = V.portfolio_on_rows(*held_rows(spark, sf), lag=lag)
        return d.select(day().alias("date"), *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("gross", "turnover", "net")], F.round("nav", 5).alias("nav"))

    QUERIES[_name] = _bt
    SQL[_name] = sql(f"SELECT {D}, round(gross, 9) + 0.0 AS gross, round(turnover, 9) + 0.0 AS turnover, round(net, 9) + 0.0 AS net, round(nav, 5) AS nav FROM bt", MOM, WEIGHTS, *_backtest(_lag), panel=True)


@query("b02_screen", sql(
    f"SELECT count(*) AS n, {q6('arg_max(nav, d) / arg_min(nav, d) - 1')} AS total_return, {q6('min(dd)')} AS max_drawdown, {q6('avg(turnover)')} AS mean_turnover FROM (SELECT *, nav / max(nav) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bt)",
    MOM, WEIGHTS, *_backtest(1), panel=True))
def b02_screen(spark: SparkSession, sf: str) -> DataFrame:
    """Factor to weights to backtest to measures in one plan."""
    d = stage_table(V.portfolio_on_rows(*held_rows(spark, sf)), "screen")  # a row per date
    m = M.summarize(d.withColumn("run", F.lit(1)), ["run"])
    return d.agg(F.avg("turnover").alias("t"), F.lit(1).alias("k")).join(m, F.col("k") == F.col("run")).select("n", r6("total_return").alias("total_return"), r6("max_drawdown").alias("max_drawdown"), r6("t").alias("mean_turnover"))


@query("b03_timing", sql(
    f"SELECT symbol, round(pow(arg_max(nav, d), 1 / greatest(date_diff('day', min(d), max(d)) / 365.25, 1e-9)) - 1, 4) AS annual, {q6('min(nav / pk - 1)')} AS max_dd, {q6('avg(pos)')} AS position_ratio, round(pow(arg_max(bh, d), 1 / greatest(date_diff('day', min(d), max(d)) / 365.25, 1e-9)) - 1, 4) AS bh_annual, {q6('min(bh / bpk - 1)')} AS bh_max_dd, count(*) FILTER (dp > 0) AS n_switches FROM t4 GROUP BY symbol",
    f"t0 AS (SELECT symbol, d, round(close - {roll('avg', 20, 'close')}, 8) AS sig, CASE WHEN close > 0 AND pre_close > 0 THEN greatest(least(close / pre_close - 1, 0.3), -0.3) END AS r FROM b)",
    f"t1 AS (SELECT symbol, d, coalesce((lag(sig > 0) OVER ({W}))::INT, 0) AS pos, coalesce(r, 0) AS r FROM t0)",
    f"t2 AS (SELECT *, coalesce(abs(pos - {lag('pos')}), 0) AS dp FROM t1)",
    f"t3 AS (SELECT *, product(1 + pos * r - dp * 0.0005) OVER ({W} ROWS UNBOUNDED PRECEDING) AS nav, product(1 + r) OVER ({W} ROWS UNBOUNDED PRECEDING) AS bh FROM t2)",
    f"t4 AS (SELECT *, max(nav) OVER ({W} ROWS UNBOUNDED PRECEDING) AS pk, max(bh) OVER ({W} ROWS UNBOUNDED PRECEDING) AS bpk FROM t3)"))
def b03_timing(spark: SparkSession, sf: str) -> DataFrame:
    w = S.line("symbol")
    move = F.when((C() > 0) & (F.col("pre_close") > 0), F.greatest(F.least(C() / F.col("pre_close") - 1, F.lit(0.3)), F.lit(-0.3)))
    s = bars(spark, sf).select("symbol", "date", F.round(C() - S.sma(C(), 20, w), 8).alias("sig"), move.alias("ret"))
    t = V.timing(s, "symbol")
    return t.select("symbol", F.round("annual", 4).alias("annual"), r6("max_dd").alias("max_dd"), r6("position_ratio").alias("position_ratio"), F.round("bh_annual", 4).alias("bh_annual"), r6("bh_max_dd").alias("bh_max_dd"), "n_switches")


REB = "rb AS (SELECT min(d) AS d FROM (SELECT DISTINCT d FROM m) GROUP BY date_trunc('month', d))"
TARGET = "tg AS (SELECT m.symbol, m.d, CASE WHEN rb.d IS NOT NULL AND count(value) OVER (PARTITION BY m.d) >= 10 THEN CASE WHEN value IS NOT NULL AND row_number() OVER (PARTITION BY m.d ORDER BY value DESC NULLS LAST, m.symbol) <= 10 THEN 0.1 ELSE 0 END END AS t FROM (SELECT symbol, d, round(value, 10) AS value FROM m) m LEFT JOIN rb ON rb.d = m.d)"


@query("x08_hold_top", sql(f"SELECT symbol, {D}, w AS weight FROM (SELECT symbol, d, coalesce(last_value(t IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS w FROM tg) WHERE w > 0", MOM, REB, TARGET, panel=True))
def x08_hold_top(spark: SparkSession, sf: str) -> DataFrame:
    p = momentum_panel(spark, sf).withColumn("value", F.round("value", 10))
    days = V.rebalance_days(bars(spark, sf).select("date").distinct(), "month")
    return V.hold_top(p, days, 10).where("weight > 0").select("symbol", day().alias("date"), "weight")


@query("x09_rebalance_days", sql(
    f"SELECT 'month' AS kind, strftime(min(d), '%Y-%m-%d') AS date FROM (SELECT DISTINCT d FROM b) GROUP BY date_trunc('month', d) UNION ALL SELECT 'week', strftime(min(d), '%Y-%m-%d') FROM (SELECT DISTINCT d FROM b) GROUP BY date_trunc('week', d) UNION ALL SELECT 'tenth', {D} FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS o FROM (SELECT DISTINCT d FROM b)) WHERE o % 10 = 0"))
def x09_rebalance_days(spark: SparkSession, sf: str) -> DataFrame:
    dates = bars(spark, sf).select("date").distinct()
    parts = [V.rebalance_days(dates, e).select(F.lit(k).alias("kind"), day().alias("date")) for k, e in (("month", "month"), ("week", "week"), ("tenth", 10))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("w17_drifted", sql(
    f"SELECT symbol, {D}, {q6('coalesce(g / nullif(sum(g) OVER (PARTITION BY d), 0), 0)')} AS weight FROM w3 WHERE g > 0",
    MOM, REB, "eq AS (SELECT m.symbol, m.d, CASE WHEN rb.d IS NOT NULL AND value IS NOT NULL THEN 1.0 / count(value) OVER (PARTITION BY m.d) WHEN rb.d IS NOT NULL THEN 0 END AS t, CASE WHEN ret IS NOT NULL THEN greatest(least(ret, 0.3), -0.3) ELSE 0 END AS r FROM m LEFT JOIN rb ON rb.d = m.d)",
    f"w1 AS (SELECT symbol, d, t, coalesce({lag('r')}, 0) AS before, count(t) OVER ({W} ROWS UNBOUNDED PRECEDING) AS span FROM eq)",
    "w2 AS (SELECT symbol, d, span, first_value(t) OVER (PARTITION BY symbol, span ORDER BY d) AS t0, product(CASE WHEN t IS NOT NULL THEN 1 ELSE 1 + before END) OVER (PARTITION BY symbol, span ORDER BY d ROWS UNBOUNDED PRECEDING) AS gr FROM w1)",
    "w3 AS (SELECT symbol, d, CASE WHEN span > 0 THEN t0 * gr END AS g FROM w2)", panel=True))
def w17_drifted(spark: SparkSession, sf: str) -> DataFrame:
    """Equal weights of the month's first day, drifting with returns held to 30 %."""
    p = held_prices(spark, sf)
    days = V.rebalance_days(bars(spark, sf).select("date").distinct(), "month").withColumn("reb", F.lit(True))
    n = F.count("value").over(Window.partitionBy("date"))
    target = F.when(F.col("reb"), F.when(F.col("value").isNotNull(), 1 / n).otherwise(0.0))
    t = p.join(days, "date", "left").select("symbol", "date", target.alias("target"), F.col("r").alias("ret"))
    return V.drifted(t).where("weight > 0").select("symbol", day().alias("date"), r6("weight").alias("weight"))


@query("w14_expanding_percentile", sql(f"SELECT {D}, {q6('less * 1.0 / before')} AS pct FROM (SELECT x.d, any_value(x.o) AS before, count(y.d) AS less FROM s x LEFT JOIN s y ON y.o < x.o AND y.a < x.a GROUP BY x.d) WHERE before >= 249", "s AS (SELECT d, sum(amount) AS a, row_number() OVER (ORDER BY d) - 1 AS o FROM (SELECT d, round(amount, 0) AS amount FROM b WHERE amount IS NOT NULL) GROUP BY d)"))
def w14_expanding_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Share of strictly earlier days whose total amount was less; a series of one value per date."""
    daily = bars(spark, sf).where("amount is not null").groupBy("date").agg(F.sum(F.round("amount", 0)).alias("a"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    seen = daily.select("date", "a", F.collect_list("a").over(before).alias("past"))
    less = F.size(F.filter("past", lambda x: x < F.col("a")))
    return seen.where(F.size("past") >= 249).select(day().alias("date"), r6(less / F.size("past")).alias("pct"))


