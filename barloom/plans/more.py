"""Further queries of the reference's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.functions import clean, cross as X, series as S
from barloom.ml import dataset as L, models
from barloom.operators import analysis as A, metrics as M, panel as P
from barloom.operators.asof import known_at
from barloom.operators.neutral import neutralize
from barloom.plans.base import D, W, bars, day, lag, q6, r2, r6, rank_pct, sql, table
from barloom.plans.problems import SQL_REPORTS, SQL_SYMBOL, reports
from barloom.plans.research import IC, MOM, PAIRS, RANKED, momentum_rows
from barloom.plans.simulated import FEATURES, LIMIT, features, make, plausible, sweep_runs
from barloom.service.operate import translate_orders
from barloom.sim.desk import Settings, simulate
from barloom.sim.rules import Costs
from barloom.sim.strategies import DualMASymmetric, FuturesShort
from barloom.sources import standardize as Z

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return add


@query("x05_neutralize_two", sql(
    f"SELECT symbol, {D}, {q6('CASE WHEN n > 3 AND c = n AND v1 * v2 - c12 * c12 > 1e-9 * v1 * v2 THEN turnover_rate - my - (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) * (x1 - m1) - (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) * (x2 - m2) END')} AS residual FROM g WHERE turnover_rate IS NOT NULL AND n > 3 AND c = n AND v1 * v2 - c12 * c12 > 1e-9 * v1 * v2",
    "e AS (SELECT symbol, d, turnover_rate, CASE WHEN turnover_rate IS NOT NULL AND amount > 0 THEN ln(amount) END AS x1, CASE WHEN turnover_rate IS NOT NULL AND close > 0 AND pre_close > 0 THEN close / pre_close END AS x2 FROM b)",
    "g AS (SELECT *, count(turnover_rate) OVER w AS n, count(CASE WHEN x1 IS NOT NULL AND x2 IS NOT NULL THEN 1 END) OVER w AS c, avg(turnover_rate) OVER w AS my, avg(x1) OVER w AS m1, avg(x2) OVER w AS m2, var_pop(x1) OVER w AS v1, var_pop(x2) OVER w AS v2, covar_pop(x1, x2) OVER w AS c12, covar_pop(x1, turnover_rate) OVER w AS c1, covar_pop(x2, turnover_rate) OVER w AS c2 FROM e WINDOW w AS (PARTITION BY d))"))
def x05_neutralize_two(spark: SparkSession, sf: str) -> DataFrame:
    """Residual of turnover on log amount and on the day's move, where the two differ."""
    t = F.col("turnover_rate").isNotNull()
    e = bars(spark, sf).select("symbol", "date", "turnover_rate", F.when(t & (F.col("amount") > 0), F.log("amount")).alias("x1"), F.when(t & (F.col("close") > 0) & (F.col("pre_close") > 0), F.col("close") / F.col("pre_close")).alias("x2"))
    w = Window.partitionBy("date")
    apart = F.var_pop("x1").over(w) * F.var_pop("x2").over(w)
    e = e.withColumn("ok", apart - F.pow(F.covar_pop("x1", "x2").over(w), F.lit(2)) > 1e-9 * apart)
    return neutralize(e, "turnover_rate", ["x1", "x2"]).where("ok and residual is not null").select("symbol", day().alias("date"), r6("residual").alias("residual"))


@query("w15_expanding_rank", sql(f"SELECT symbol, {D}, {q6('pct')} AS pct FROM (SELECT x.symbol, x.d, (count(*) FILTER (y.close < x.close) + (count(*) FILTER (y.close = x.close) + 1) / 2.0) / count(*) AS pct, count(*) AS n FROM b x JOIN b y ON y.symbol = x.symbol AND y.d <= x.d GROUP BY ALL) WHERE n >= 20"))
def w15_expanding_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Average rank of each close among all up to it, as a share; 20 values at least.

    Ranks come from a sorted list per symbol, grown by binary insertion: a symbol's history is bounded by the calendar.
    """
    import bisect

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        seen, out = [], []
        for v in pdf["close"]:
            lo, hi = bisect.bisect_left(seen, v), bisect.bisect_right(seen, v)
            seen.insert(hi, v)
            out.append((lo + (hi - lo + 2) / 2) / len(seen))
        return pdf[["symbol", "date"]].assign(pct=out).iloc[19:]

    return bars(spark, sf).select("symbol", "date", "close").groupBy("symbol").applyInPandas(run, "symbol string, date date, pct double").select("symbol", day().alias("date"), r6("pct").alias("pct"))


@query("a10_trade_stats", "SELECT strategy, count(*) AS n_trades, round(sum(fees), 2) AS total_fees, round(avg(CASE WHEN c THEN (pnl > 0)::INT END), 6) AS trade_win_rate, round(sum(CASE WHEN c AND pnl > 0 THEN pnl END) / -sum(CASE WHEN c AND pnl < 0 THEN pnl END), 6) AS profit_factor, max(CASE WHEN c THEN pnl END) AS max_single_win, min(CASE WHEN c THEN pnl END) AS max_single_loss FROM (SELECT strategy, side = 'sell' AS c, (signal_id % 101 - 50)::DOUBLE AS pnl, (signal_id % 7) * 0.5::DOUBLE AS fees FROM signals WHERE side IS NOT NULL) GROUP BY strategy")
def a10_trade_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "signals").where("side is not null").select("strategy", (F.col("side") == "sell").alias("closing"), (F.col("signal_id") % 101 - 50.0).alias("pnl"), ((F.col("signal_id") % 7) * 0.5).alias("fees"), F.lit(0.0).alias("value"))
    s = M.trade_stats(t, ["strategy"])
    return s.select("strategy", "n_trades", r2("total_fees").alias("total_fees"), r6("trade_win_rate").alias("trade_win_rate"), r6("profit_factor").alias("profit_factor"), "max_single_win", "max_single_loss")


@query("a08_sortino", sql(f"SELECT symbol, {q6('CASE WHEN risk > 1e-12 THEN m * 252 / risk ELSE 0 END')} AS sortino FROM (SELECT symbol, avg(r) AS m, sqrt(avg(pow(least(r, 0), 2))) * sqrt(252) AS risk FROM (SELECT symbol, close / pre_close - 1 AS r FROM b WHERE close > 0 AND pre_close > 0) GROUP BY symbol)"))
def a08_sortino(spark: SparkSession, sf: str) -> DataFrame:
    r = bars(spark, sf).where("close > 0 and pre_close > 0").select("symbol", (F.col("close") / F.col("pre_close") - 1).alias("r"))
    return r.groupBy("symbol").agg(r6(M.sortino(F.col("r"))).alias("sortino"))


@query("f09_announced_change", f"""SELECT symbol, strftime(date, '%Y-%m-%d') AS date, -npg AS value FROM (SELECT DISTINCT symbol, date::DATE AS date, substr(symbol, 1, 6) AS code FROM daily_bars) q
    ASOF JOIN (SELECT z.code, z.ann_date, arg_max(y.npg, (z.period, y.report_id)) AS npg FROM yjbb y JOIN ({SQL_REPORTS}) z USING (report_id) WHERE y.npg::VARCHAR <> 'nan' AND z.ann_date > z.period AND z.code IS NOT NULL GROUP BY ALL) r ON q.code = r.code AND q.date >= r.ann_date""")
def f09_announced_change(spark: SparkSession, sf: str) -> DataFrame:
    """The last announced change, turned around, on every bar from its day on."""
    y = table(spark, sf, "yjbb").select(F.col("report_id").alias("__id"), clean.present("npg").alias("npg"))
    said = reports(spark, sf).where("code is not null and ann_date > period").join(y, F.col("report_id") == F.col("__id")).where("npg is not null")
    b = table(spark, sf, "daily_bars").select("symbol", F.col("date").cast("date").alias("date")).distinct().withColumn("code", F.substring("symbol", 1, 6))
    k = known_at(b, said, event_entity="code", event_time="date", entity="code", known="ann_date", rank=["ann_date", "period", "report_id"], attributes=["npg"], how="inner")
    return k.select("symbol", day().alias("date"), (-F.col("npg")).alias("value"))


@query("j12_value_asof", sql(f"SELECT symbol, {D}, round(close * last_value(CASE WHEN turnover_rate > 0 AND volume > 0 THEN volume * 10000 / turnover_rate END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) / 1e8, 4) AS market_value FROM b"))
def j12_value_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Market value from the float as last seen on or before the day: lots traded over the share of the float they were."""
    seen = F.when((F.col("turnover_rate") > 0) & (F.col("volume") > 0), F.col("volume") * 10000 / F.col("turnover_rate"))
    held = S.fill_forward(seen, S.line("symbol"))
    return bars(spark, sf).select("symbol", day().alias("date"), F.round(F.col("close") * held / 1e8, 4).alias("market_value"))


_SAID = f"""ASOF LEFT JOIN (SELECT z.code, z.ann_date, arg_max({{'roe': z.roe, 'gpm': CASE WHEN y.gpm::VARCHAR <> 'nan' THEN y.gpm END, 'npg': CASE WHEN y.npg::VARCHAR <> 'nan' THEN y.npg END, 'srg': CASE WHEN y.srg::VARCHAR <> 'nan' THEN y.srg END}}, (z.period, report_id)) AS v
    FROM yjbb y JOIN ({SQL_REPORTS}) z USING (report_id) WHERE z.ann_date > z.period AND z.code IS NOT NULL GROUP BY ALL) r ON substr(q.symbol, 1, 6) = r.code AND q.d >= r.ann_date"""


@query("f08_growth", sql(
    f"SELECT symbol, {D}, npg, srg, {q6('(' + rank_pct('roe', 'd') + ' + ' + rank_pct('gpm', 'd') + ') / 2')} AS qual, {q6('(' + rank_pct('npg', 'd') + ' + ' + rank_pct('srg', 'd') + ') / 2')} AS vg FROM k",
    f"k AS (SELECT q.symbol, q.d, v.roe AS roe, v.gpm AS gpm, v.npg AS npg, v.srg AS srg FROM (SELECT symbol, d FROM b) q {_SAID})"))
def f08_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Growth of profit and sales as last announced, and the mean rank of quality (roe, gpm) and of growth within each day."""
    y = table(spark, sf, "yjbb").select(F.col("report_id").alias("__id"), *[clean.present(c).alias(c) for c in ("gpm", "npg", "srg")])
    said = reports(spark, sf).where("code is not null and ann_date > period").join(y, F.col("report_id") == F.col("__id"))
    b = bars(spark, sf).select("symbol", "date", F.substring("symbol", 1, 6).alias("code"))
    k = known_at(b, said, event_entity="code", event_time="date", entity="code", known="ann_date", rank=["ann_date", "period", "report_id"], attributes=["roe", "gpm", "npg", "srg"])
    pct = {c: X.rank_pct(F.col(c), ["date"]) for c in ("roe", "gpm", "npg", "srg")}
    return k.select("symbol", day().alias("date"), "npg", "srg", r6((pct["roe"] + pct["gpm"]) / 2).alias("qual"), r6((pct["npg"] + pct["srg"]) / 2).alias("vg"))


@query("f08_value", sql(
    f"SELECT q.symbol, {D.replace('d,', 'q.d,')}, round(v.ttm / nullif(mv, 0), 6) + 0.0 AS ep, {q6('CASE WHEN mv > 0 THEN -ln(mv / 1e8) END')} AS size FROM m q ASOF LEFT JOIN (SELECT code, ann_date, arg_max({{'ttm': ttm}}, period) AS v FROM t WHERE ttm IS NOT NULL GROUP BY ALL) r ON substr(q.symbol, 1, 6) = r.code AND q.d >= r.ann_date",
    f"m AS (SELECT symbol, d, round(close * last_value(CASE WHEN turnover_rate > 0 AND volume > 0 THEN volume * 10000 / turnover_rate END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 2) AS mv FROM b)",
    f"u AS (SELECT code, period, arg_max(profit, (ann_date, report_id)) AS profit, max(ann_date) AS ann_date FROM (SELECT y.report_id, z.code, z.period, z.ann_date, CASE WHEN y.profit::VARCHAR <> 'nan' THEN y.profit END AS profit FROM yjbb y JOIN ({SQL_REPORTS}) z USING (report_id)) WHERE profit IS NOT NULL AND ann_date > period AND code IS NOT NULL GROUP BY ALL)",
    "q1 AS (SELECT *, lag(profit) OVER w AS pp, lag(period) OVER w AS pd FROM u WINDOW w AS (PARTITION BY code ORDER BY period))",
    "s1 AS (SELECT code, period, ann_date, profit - CASE WHEN year(pd) = year(period) AND quarter(pd) = quarter(period) - 1 THEN pp ELSE 0 END AS single FROM q1)",
    "t AS (SELECT code, period, ann_date, CASE WHEN count(*) OVER f = 4 THEN sum(single) OVER f END AS ttm FROM s1 WINDOW f AS (PARTITION BY code ORDER BY period ROWS 3 PRECEDING))"))
def f08_value(spark: SparkSession, sf: str) -> DataFrame:
    """Profit of the last four quarters, as last announced, over the market value; and the negative logarithm of that value in units of 1e8."""
    y = table(spark, sf, "yjbb").select(F.col("report_id").alias("__id"), clean.present("profit").alias("profit"))
    r = reports(spark, sf).join(y, F.col("report_id") == F.col("__id")).where("profit is not null and ann_date > period and code is not null")
    r = r.groupBy("code", "period").agg(F.max_by("profit", F.struct("ann_date", "report_id")).alias("profit"), F.max("ann_date").alias("ann_date"))
    w = Window.partitionBy("code").orderBy("period")
    before = F.lag("period").over(w)
    same = (F.year(before) == F.year("period")) & (F.quarter(before) == F.quarter("period") - 1)
    single = r.withColumn("single", F.col("profit") - F.when(same, F.lag("profit").over(w)).otherwise(0.0))
    t = single.select("code", "period", "ann_date", S.rolling(F.sum, F.col("single"), 4, w).alias("ttm")).where("ttm is not null")
    seen = F.when((F.col("turnover_rate") > 0) & (F.col("volume") > 0), F.col("volume") * 10000 / F.col("turnover_rate"))
    b = bars(spark, sf).select("symbol", "date", F.substring("symbol", 1, 6).alias("code"), F.round(F.col("close") * S.fill_forward(seen, S.line("symbol")), 2).alias("mv"))
    k = known_at(b, t, event_entity="code", event_time="date", entity="code", known="ann_date", rank=["ann_date", "period"], attributes=["ttm"])
    return k.select("symbol", day().alias("date"), r6(clean.ratio(F.col("ttm"), F.col("mv"))).alias("ep"), r6(F.when(F.col("mv") > 0, -F.log(F.col("mv") / 1e8))).alias("size"))


@query("j12_market_value", sql(f"SELECT b.symbol, {D}, round(close * float_shares / 1e8, 6) AS market_value FROM b LEFT JOIN (SELECT symbol, max(float_shares) AS float_shares FROM instruments GROUP BY 1) i ON i.symbol = b.symbol"))
def j12_market_value(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "instruments").groupBy("symbol").agg(F.max("float_shares").alias("float_shares"))
    return bars(spark, sf).join(i, "symbol", "left").select("symbol", day().alias("date"), F.round(F.col("close") * F.col("float_shares") / 1e8, 6).alias("market_value"))


@query("j04_members", sql(f"SELECT symbol, {D}, close FROM b WHERE (symbol, d) IN (SELECT {SQL_SYMBOL.format('symbol')}, date::DATE FROM bar_versions)"))
def j04_members(spark: SparkSession, sf: str) -> DataFrame:
    """Bars that are members of another list, by symbol and day."""
    v = table(spark, sf, "bar_versions").select(clean.canon_symbol("symbol").alias("symbol"), F.col("date").cast("date").alias("date")).distinct()
    return bars(spark, sf).join(v, ["symbol", "date"], "left_semi").select("symbol", day().alias("date"), "close")


@query("j07_calendar_reindex", sql(f"SELECT strftime(c.date, '%Y-%m-%d') AS date, round(m, 10) AS mean_turnover FROM (SELECT DISTINCT date FROM calendar WHERE date IS NOT NULL) c LEFT JOIN (SELECT d, avg(turnover_rate) AS m FROM b GROUP BY d) x ON x.d = c.date"))
def j07_calendar_reindex(spark: SparkSession, sf: str) -> DataFrame:
    m = bars(spark, sf).groupBy("date").agg(F.avg("turnover_rate").alias("m"))
    return P.trading_days(table(spark, sf, "calendar")).join(m, "date", "left").select(day().alias("date"), F.round("m", 10).alias("mean_turnover"))


@query("j19_order_bar", sql("SELECT s.signal_id, CASE WHEN b.symbol IS NULL THEN 'SUSPENDED' ELSE 'FILLED' END AS outcome, b.open AS price FROM signals s LEFT JOIN b ON b.symbol = s.symbol AND b.d = s.ts::DATE"))
def j19_order_bar(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and the bar of their day; without one they are refused."""
    b = bars(spark, sf).select(F.col("symbol").alias("__s"), F.col("date").alias("__d"), "open")
    s = table(spark, sf, "signals").withColumn("day", F.col("ts").cast("date"))
    return s.join(b, (F.col("symbol") == F.col("__s")) & (F.col("day") == F.col("__d")), "left").select("signal_id", F.when(F.col("__s").isNull(), "SUSPENDED").otherwise("FILLED").alias("outcome"), F.col("open").alias("price"))


@query("pr02_projection", sql(f"SELECT symbol, {D}, high, low FROM b"))
def pr02_projection(spark: SparkSession, sf: str) -> DataFrame:
    wanted = dict.fromkeys(["symbol", "date", "high", "low", "high"])
    return bars(spark, sf).select(*wanted).withColumn("date", day())


@query("a22_prediction_ic")
def a22_prediction_ic(spark: SparkSession, sf: str) -> DataFrame:
    """Daily rank correlation of walk-forward predictions, per split."""
    data = L.build_dataset(features(spark, sf), FEATURES, 5)
    p = models.predict_linear(data, L.walk_forward(bars(spark, sf).select("date").distinct(), 250, 60, 60), FEATURES)
    ic = A.rank_ic(p, "prediction", "label")
    split = p.select("date", "split").distinct()
    return ic.join(split, "date").groupBy("split").agg(r6(F.avg("rank_ic")).alias("test_ic"), F.count(F.lit(1)).alias("days"))


@query("a24_importance")
def a24_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each feature in the models, over the splits."""
    data = L.build_dataset(features(spark, sf), FEATURES, 5)
    p = models.predict_linear(data, L.walk_forward(bars(spark, sf).select("date").distinct(), 250, 60, 60), FEATURES)
    each = p.groupBy("split").agg(F.first("importance").alias("w")).select("split", F.posexplode("w").alias("k", "w"))
    name = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("k") + 1)
    return each.groupBy(name.alias("feature")).agg(r6(F.avg("w")).alias("importance"))


@query("m04_trees")
def m04_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees on the last splits, each a distributed fit."""
    data = L.build_dataset(features(spark, sf), FEATURES, 5)
    splits = L.walk_forward(bars(spark, sf).select("date").distinct(), 700, 250, 250)
    return models.prediction_ic(models.predict_trees(data, splits, FEATURES, rounds=5, depth=3))


@query("s22_overseas", sql(f"SELECT symbol, {D}, close, {q6('CASE WHEN close > 0 THEN adj / close END')} AS adj_factor, {lag('close')} AS pre_close FROM (SELECT *, close * coalesce(adj_factor, 1) AS adj FROM b) WHERE d < DATE '2024-12-01'"))
def s22_overseas(spark: SparkSession, sf: str) -> DataFrame:
    """A feed with zoned times, an exclusive end and adjusted closes."""
    b = bars(spark, sf)
    raw = b.select("symbol", F.to_timestamp(F.concat(day(), F.lit(" 00:00:00+00:00"))).alias("date"), "open", "high", "low", "close", "volume", (F.col("close") * F.coalesce("adj_factor", F.lit(1.0))).alias("adj_close"))
    return Z.overseas(raw, end="2024-11-30").select("symbol", day().alias("date"), "close", r6("adj_factor").alias("adj_factor"), "pre_close")


@query("s25_csv_round", "SELECT source, trust FROM feeds")
def s25_csv_round(spark: SparkSession, sf: str) -> DataFrame:
    """A table written as CSV and read with its schema."""
    import uuid

    from barloom.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/barloom-csv-{uuid.uuid4().hex}"
    table(spark, sf, "feeds").select("source", "trust").write.option("header", True).csv(path)
    return spark.read.schema("source string, trust int").option("header", True).csv(path)


@query("e02_same_close", sql(
    "SELECT symbol AS run_id, round(CASE WHEN qty > 0 THEN 1e6 - qty * c0 + qty * f / nullif(f0, 0) * close ELSE 1e6 END, 2) AS nav FROM z",
    f"n AS (SELECT symbol, d, close, pre_close, last_value(adj_factor IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS f, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) - 1 AS n FROM b WHERE open > 0 AND close > 0 AND high > 0 AND low > 0)",
    f"s AS (SELECT symbol, max(close) FILTER (i = 0) AS c0, max(coalesce(pre_close, close)) FILTER (i = 0) AS p0, arg_min(f, d) FILTER (f IS NOT NULL) AS f0 FROM n GROUP BY symbol)",
    f"z AS (SELECT n.symbol, n.close, coalesce(n.f, s.f0, 1) AS f, coalesce(s.f0, 1) AS f0, s.c0, CASE WHEN c0 < floor(p0 * (1 + {LIMIT.replace('symbol', 'n.symbol')}) * 100 + 0.5) / 100 - 1e-6 THEN floor(1e6 / c0 / 100) * 100 ELSE 0 END AS qty FROM n JOIN s USING (symbol) WHERE n.i = n.n)"))
def e02_same_close(spark: SparkSession, sf: str) -> DataFrame:
    """Filled at the close of the signal's day; value at the end."""
    runs = sweep_runs(plausible(spark, sf).select("universe").distinct(), [{"strategy": "BuyAndHold", "free": True, "execution": "same_close"}])
    rows = simulate(plausible(spark, sf), runs, make).where("kind = 'nav'")
    return rows.groupBy(F.substring_index("run_id", "#", 1).alias("run_id")).agg(F.round(F.max_by("value", "at"), 2).alias("nav"))


@query("e12_accounts", sql("SELECT DISTINCT substr(symbol, 1, 3) AS run_id, 0::BIGINT AS overdrawn, 0::BIGINT AS sold_on_day_bought, 0::BIGINT AS odd_lots, true AS cash_adds_up FROM b WHERE open > 0 AND close > 0 AND high > 0 AND low > 0"))
def e12_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Portfolios of several symbols that share cash, one per first three digits of the code: what their books must not show, and that cash adds up."""
    b = plausible(spark, sf).withColumn("universe", F.substring("symbol", 1, 3))
    of = b.groupBy("universe").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    params = F.to_json(F.struct(F.lit("DualMA").alias("strategy"), F.lit(3).alias("fast"), F.lit(8).alias("slow"), F.lit(0.3).alias("cap"), "symbols"))
    rows = simulate(b, of.select(F.col("universe").alias("run_id"), "universe", params.alias("params")), make)
    trade, buy = F.col("kind") == "trade", F.col("side") == "buy"
    per_day = rows.groupBy("run_id", "symbol", F.col("at").cast("date").alias("day")).agg(
        F.count_if(trade & (F.col("cash") < -0.01)).alias("overdrawn"), (F.max(F.coalesce(trade & buy, F.lit(False))) & F.max(F.coalesce(trade & ~buy, F.lit(False)))).cast("int").alias("both"),
        F.count_if(trade & buy & (F.col("qty") % 100 != 0)).alias("odd"),
        F.sum(F.when(trade, F.when(buy, -F.col("value")).otherwise(F.col("value")) - F.col("fees"))).alias("flow"), F.max(F.when(F.col("kind") == "nav", F.struct("at", "cash"))).alias("last"),
    )
    adds = F.abs(1e6 + F.coalesce(F.sum("flow"), F.lit(0.0)) - F.max("last").cash) < 0.05
    return per_day.groupBy("run_id").agg(F.sum("overdrawn").alias("overdrawn"), F.sum("both").alias("sold_on_day_bought"), F.sum("odd").alias("odd_lots"), adds.alias("cash_adds_up"))


@query("v07_orders", """SELECT signal_id, side, CASE WHEN side = 'buy' THEN q // 100 * 100 ELSE q END AS quantity, CASE WHEN CASE WHEN side = 'buy' THEN q // 100 * 100 ELSE q END > 0 THEN round(close * CASE WHEN side = 'buy' THEN 1.02 ELSE 0.98 END, 3) END AS limit_price,
    CASE WHEN CASE WHEN side = 'buy' THEN q // 100 * 100 ELSE q END <= 0 THEN 'LOT_TOO_SMALL' WHEN close IS NULL THEN 'NO_REF_PRICE' END AS note
    FROM (SELECT signal_id, symbol, side, signal_id * 37 % 1500 AS q FROM signals WHERE side IS NOT NULL) s LEFT JOIN (SELECT symbol, arg_max(close, (date::DATE, updated_at)) AS close FROM daily_bars GROUP BY 1) b USING (symbol)""")
def v07_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Signals as orders of made-up sizes, in lots and with a limit of two percent around the last close."""
    orders = table(spark, sf, "signals").where("side is not null").select("signal_id", "symbol", "side", (F.col("signal_id") * 37 % 1500).alias("qty"))
    last = bars(spark, sf).groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    return translate_orders(orders, last, 0.02).select("signal_id", "side", "quantity", "limit_price", "note")


@query("e07_futures")
def e07_futures(spark: SparkSession, sf: str) -> DataFrame:
    """Long and short futures portfolios over weekly prices of brands taken as continuous contracts."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    week = li.groupBy("p_brand", F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(F.min_by(unit, order).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.avg(unit).alias("close"))
    b = week.withColumn("symbol", F.lit("RB.SHFE")).withColumn("universe", F.col("p_brand")).withColumn("adj_factor", F.lit(1.0))
    b = b.withColumn("pre_close", F.lag("close").over(Window.partitionBy("universe").orderBy("date")))

    def build(params: dict):
        kind = DualMASymmetric if params["strategy"] == "turn" else FuturesShort
        return kind(symbols=["RB.SHFE"], lots=params["lots"]), Settings(costs=Costs())

    runs = b.select("universe").distinct().select(F.col("universe"), F.explode(F.array(F.lit('{"strategy": "turn", "lots": 2}'), F.lit('{"strategy": "short", "lots": 3}'))).alias("params")).withColumn("run_id", F.concat_ws("#", "universe", F.get_json_object("params", "$.strategy")))
    rows = simulate(b, runs, build)
    return rows.groupBy("run_id").agg(F.round(F.max_by(F.when(F.col("kind") == "nav", F.col("value")), F.when(F.col("kind") == "nav", F.col("at"))), 2).alias("nav"), F.count_if(F.col("kind") == "trade").alias("fills"), F.round(F.sum("fees"), 2).alias("fees"))


@query("e18_benchmark", sql(f"SELECT {D}, round(m / base, 6) AS bench FROM (SELECT d, avg(close) AS m FROM b WHERE close > 0 GROUP BY d) CROSS JOIN (SELECT arg_max(m, d) AS base FROM (SELECT d, avg(close) AS m FROM b WHERE close > 0 GROUP BY d) WHERE d < DATE '2024-01-01') WHERE d >= DATE '2024-01-01'"))
def e18_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Mean close over its last value before the start."""
    m = bars(spark, sf).where("close > 0").groupBy("date").agg(F.avg("close").alias("m"))
    base = F.max(F.when(F.col("date") < F.lit("2024-01-01").cast("date"), F.struct("date", "m"))).over(Window.partitionBy())
    return m.withColumn("base", base).where("date >= '2024-01-01'").select(day().alias("date"), F.round(F.col("m") / F.col("base.m"), 6).alias("bench"))


@query("e14_valuation", sql("SELECT symbol, round(n * 100 * close, 2) AS market_value, round(n * 100 * close / sum(n * 100 * close) OVER (), 6) AS weight FROM (SELECT symbol, count(*) AS n FROM signals WHERE side = 'buy' GROUP BY 1) JOIN (SELECT symbol, arg_max(close, d) AS close FROM b GROUP BY 1) USING (symbol)"))
def e14_valuation(spark: SparkSession, sf: str) -> DataFrame:
    """Market value and weight of holdings at the last close."""
    held = table(spark, sf, "signals").where("side = 'buy'").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    last = bars(spark, sf).groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    v = F.col("n") * 100 * F.col("close")
    return held.join(last, "symbol").select("symbol", r2(v).alias("market_value"), r6(v / F.sum(v).over(Window.partitionBy())).alias("weight"))


@query("a23_window_ic", sql(f"SELECT strftime(date_trunc('month', d), '%Y-%m') AS month, {q6('avg(rank_ic)')} AS mean_ic, count(*) AS days FROM ic GROUP BY 1", MOM, PAIRS, RANKED, IC, panel=True))
def a23_window_ic(spark: SparkSession, sf: str) -> DataFrame:
    """Mean daily rank correlation per month."""
    return A.rank_ic(momentum_rows(spark, sf)[0]).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(r6(F.avg("rank_ic")).alias("mean_ic"), F.count(F.lit(1)).alias("days"))

