"""Queries of simulation, learning, optimisation, and stream-like batches."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions import series as S
from barloom.ml import dataset as L, models, optimize
from barloom.operators import factors
from barloom.plans.base import D, W, bars, day, dense, lag, moves, q6, r6, roll, sql, table
from barloom.sim.desk import Settings, simulate
from barloom.sim.grid import clean_factors, grid_trading
from barloom.sim.rules import FREE
from barloom.sim.strategies import SHIPPED
from barloom.streaming.live import bars_from_ticks, first_alerts

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


def plausible(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with positive prices only."""
    return bars(spark, sf).where("open > 0 and close > 0 and high > 0 and low > 0").withColumn("universe", F.col("symbol"))


def make(params: dict):
    settings = Settings(weight_cap=params.get("cap"), costs=FREE if params.get("free") else Settings().costs, halt=params.get("halt"), execution=params.get("execution", "next_open"))
    return SHIPPED[params["strategy"]](**params), settings


LIMIT = "CASE WHEN symbol LIKE '%.BJ' THEN 0.3 WHEN symbol SIMILAR TO '(688|689).*SH' OR symbol SIMILAR TO '(300|301).*SZ' THEN 0.2 ELSE 0.1 END"


@query("e01_buy_and_hold", sql(
    f"""SELECT symbol AS run_id, {D}, round(CASE WHEN qty > 0 AND i >= 1 THEN 1e6 - qty * o1 + qty * g * close ELSE 1e6 END, 2) AS nav FROM y""",
    f"n AS (SELECT symbol, d, open, close, pre_close, last_value(adj_factor IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS f, row_number() OVER ({W}) - 1 AS i FROM b WHERE open > 0 AND close > 0 AND high > 0 AND low > 0)",
    f"s AS (SELECT symbol, max(close) FILTER (i = 0) AS c0, max(open) FILTER (i = 1) AS o1, max(coalesce(pre_close, close)) FILTER (i = 1) AS p1, max(f) FILTER (i = 0) AS f0, max(f) FILTER (i = 1) AS f1 FROM n GROUP BY symbol)",
    f"q AS (SELECT symbol, o1, f1, CASE WHEN o1 < floor(p1 * (1 + {LIMIT}) * 100 + 0.5) / 100 - 1e-6 THEN CASE WHEN floor(1e6 / c0 / 100) * 100 * o1 <= 1e6 + 1e-6 THEN floor(1e6 / c0 / 100) * 100 ELSE floor(1e6 / o1 / 100) * 100 END ELSE 0 END AS qty FROM s)",
    "y AS (SELECT n.symbol, n.d, n.close, n.i, q.qty, q.o1, CASE WHEN n.f IS NULL OR n.i <= 1 THEN 1 ELSE coalesce(n.f / nullif(coalesce(q.f1, first_value(n.f IGNORE NULLS) OVER (PARTITION BY n.symbol ORDER BY n.d)), 0), 1) END AS g FROM n JOIN q USING (symbol))"))
def e01_buy_and_hold(spark: SparkSession, sf: str) -> DataFrame:
    """One portfolio per symbol: all in on the first signal, without costs."""
    runs = plausible(spark, sf).select("universe").distinct().select(F.col("universe").alias("run_id"), "universe", F.concat(F.lit('{"strategy": "BuyAndHold", "free": true, "symbols": ["'), F.col("universe"), F.lit('"]}')).alias("params"))
    rows = simulate(plausible(spark, sf), runs, make)
    return rows.where("kind = 'nav'").select("run_id", day("at").alias("date"), F.round("value", 2).alias("nav"))


@query("e20_sweep")
def e20_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Crossing-average portfolios of every symbol under several parameter sets: last value, fills and refusals of each run."""
    universes = plausible(spark, sf).select("universe").distinct()
    grid = [{"strategy": "DualMA", "fast": f, "slow": s, "cap": 0.95} for f, s in ((5, 20), (10, 60))]

    rows = simulate(plausible(spark, sf), sweep_runs(universes, grid), make)
    return rows.groupBy("run_id").agg(r6(F.max_by(F.when(F.col("kind") == "nav", F.col("value")), F.when(F.col("kind") == "nav", F.col("at")))).alias("nav"), F.count_if(F.col("kind") == "trade").alias("fills"), F.count_if(F.col("kind") == "rejection").alias("refused"))


def sweep_runs(universes: DataFrame, grid: list[dict]) -> DataFrame:
    """Runs of every parameter set on every one-symbol universe; the symbol goes into the parameters."""
    heads = F.array(*[F.lit(json.dumps(g, sort_keys=True)[:-1]) for g in grid])
    each = universes.select("universe", F.posexplode(heads).alias("k", "head"))
    return each.select(F.concat_ws("#", "universe", F.col("k").cast("string")).alias("run_id"), "universe", F.concat("head", F.lit(', "symbols": ["'), F.col("universe"), F.lit('"]}')).alias("params"))


@query("e16_rejections")
def e16_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Why orders of halted, capped portfolios were refused."""
    universes = plausible(spark, sf).select("universe").distinct()
    runs = sweep_runs(universes, [{"strategy": "MaTiming", "n": 20, "cap": 0.5, "halt": 0.1}])
    return simulate(plausible(spark, sf), runs, make).where("kind = 'rejection'").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("b04_grid")
def b04_grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid_trading(plausible(spark, sf), 0.08, 10).select("symbol", day().alias("date"), r6("nav").alias("nav"))


@query("w16_clean_steps", sql(
    f"SELECT symbol, {D}, k AS factor FROM y",
    "n AS (SELECT symbol, d, adj_factor AS f, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM b)",
    "y(symbol, d, i, k) AS (SELECT symbol, d, i, f FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.d, n.i, CASE WHEN n.f IS NULL THEN y.k WHEN y.k IS NULL OR abs(n.f / y.k - 1) > 0.005 THEN n.f ELSE y.k END FROM y JOIN n ON n.symbol = y.symbol AND n.i = y.i + 1)").replace("WITH b AS", "WITH RECURSIVE b AS", 1))
def w16_clean_steps(spark: SparkSession, sf: str) -> DataFrame:
    c = clean_factors(bars(spark, sf))
    return c.select("symbol", day().alias("date"), F.when(~F.isnan("factor"), F.col("factor")).alias("factor"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    ready = factors.prepare(dense(spark, sf, FIELDS))
    w = S.line("symbol")
    return ready.select("symbol", "date", "h", S.roc(F.col("h"), 5, w).alias("mom5"), S.roc(F.col("h"), 20, w).alias("mom20"), S.deviation(F.col("ret"), 20, w).alias("vol20"))


FEATURES = ["mom5", "mom20", "vol20"]


@query("m02_dataset", sql(f"SELECT * FROM (SELECT symbol, {D}, {q6(f'h / nullif({lag("h", 5)}, 0) - 1')} AS mom5, {q6(f'h / nullif({lag("h", 20)}, 0) - 1')} AS mom20, {q6(roll('stddev_samp', 20, 'ret'))} AS vol20, {q6(f'lead(h, 5) OVER ({W}) / nullif(h, 0) - 1')} AS label FROM p) WHERE mom5 IS NOT NULL AND mom20 IS NOT NULL AND vol20 IS NOT NULL AND label IS NOT NULL", panel=True))
def m02_dataset(spark: SparkSession, sf: str) -> DataFrame:
    d = L.build_dataset(features(spark, sf), FEATURES, 5)
    return d.select("symbol", day().alias("date"), *[r6(c).alias(c) for c in (*FEATURES, "label")])


@query("m01_stack", sql("SELECT " + D + ", symbol AS key, field AS symbol, value FROM (SELECT symbol, d, unnest(['open', 'high', 'low', 'close', 'turnover_rate']) AS field, unnest([open, high, low, close, turnover_rate]) AS value FROM b) WHERE value IS NOT NULL"))
def m01_stack(spark: SparkSession, sf: str) -> DataFrame:
    """A wide table to rows, missing cells left out."""
    wide = bars(spark, sf).select(F.col("symbol").alias("key"), "date", "open", "high", "low", "close", "turnover_rate")
    return L.stack(wide, "value", ("date", "key")).select(day().alias("date"), "key", "symbol", "value")


@query("m03_splits", sql(f"SELECT k::INT AS split, {D}, CASE WHEN o - k * 60 < 250 THEN 'train' ELSE 'test' END AS part FROM t JOIN (SELECT unnest(range(0, 1000)) AS k) ks ON o >= k * 60 AND o < k * 60 + 310 AND k * 60 + 310 <= n", "t AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS o, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM b))"))
def m03_splits(spark: SparkSession, sf: str) -> DataFrame:
    return L.walk_forward(bars(spark, sf).select("date").distinct(), 250, 60, 60).withColumn("date", day())


@query("m05_walk_forward")
def m05_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of linear models per split; moments are aggregated, models solved per split."""
    data = L.build_dataset(features(spark, sf), FEATURES, 5)
    splits = L.walk_forward(bars(spark, sf).select("date").distinct(), 250, 60, 60)
    return models.predict_linear(data, splits, FEATURES).select("split", "symbol", day().alias("date"), r6("prediction").alias("prediction"), r6("label").alias("label"))


@query("m06_yearly")
def m06_yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Daily rank correlation of yearly expanding models, summed up."""
    data = L.build_dataset(features(spark, sf), FEATURES, 5)
    return models.prediction_ic(models.predict_linear(data, models.yearly_splits(bars(spark, sf).select("date")), FEATURES))


@query("m07_weights")
def m07_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of three optimisers for all symbols over all dates; none for a symbol with fewer than the 20 moves of a20.

    A matrix of pairwise common days is not positive semidefinite on histories this uneven, so least variance would have no meaning on it.
    The moves, centred and divided by the root of their number less one, are a factor of a covariance with each symbol's own sample variance.
    """
    # a row per symbol with plain numbers: the driver holds no object per bar
    pair = F.when(F.col("r").isNotNull(), F.struct(F.unix_date("date").alias("d"), "r"))
    each = moves(spark, sf).groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.collect_list(pair).alias("p")).select("symbol", "n", "m", F.col("p.d").alias("d"), F.col("p.r").alias("r"))
    seen = each.toArrow().to_pandas().sort_values("symbol", ignore_index=True)
    held = seen[seen["n"] >= 20].reset_index(drop=True)
    if held.empty:
        return spark.createDataFrame(seen[["symbol"]], "symbol string").select("symbol", *[F.lit(None).cast("double").alias(c) for c in ("min_variance", "mean_variance", "risk_parity")])
    days = np.unique(np.concatenate(held["d"].to_list()))
    at = [np.searchsorted(days, d) for d in held["d"]]
    z = [(r - m) / np.sqrt(n - 1) for r, m, n in zip(held["r"], held["m"], held["n"])]
    sigma = optimize.Factored.of_columns(at, z, len(days), 1e-8)
    held = held[["symbol"]].assign(min_variance=optimize.min_variance(sigma), mean_variance=optimize.mean_variance(held["m"].to_numpy(), sigma), risk_parity=sigma.risk_parity())
    found = seen[["symbol"]].merge(held, "left", "symbol")
    return spark.createDataFrame(found, "symbol string, min_variance double, mean_variance double, risk_parity double").select("symbol", *[r6(F.when(~F.isnan(c), F.col(c))).alias(c) for c in found.columns[1:]])


@query("t03_bars_from_ticks", "SELECT event_type AS symbol, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS bar, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume, round(sum(value), 6) AS amount FROM events GROUP BY ALL")
def t03_bars_from_ticks(spark: SparkSession, sf: str) -> DataFrame:
    ticks = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")
    b = bars_from_ticks(ticks)
    return b.select("symbol", F.date_format("date", "yyyy-MM-dd HH:mm").alias("bar"), "open", "high", "low", "close", "volume", F.round("amount", 6).alias("amount"))


@query("t05_alerts", """WITH RECURSIVE n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
    y(user_id, ts, i, passed, ok) AS (SELECT user_id, ts, i, ts, true FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.ts, n.i, CASE WHEN epoch(n.ts) - epoch(y.passed) >= 43200 THEN n.ts ELSE y.passed END, epoch(n.ts) - epoch(y.passed) >= 43200 FROM y JOIN n ON n.user_id = y.user_id AND n.i = y.i + 1)
    SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM y WHERE ok""")
def t05_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts passed on: at most one per key in half a day, those held back do not prolong the wait."""
    e = table(spark, sf, "events").select("user_id", "ts")
    return first_alerts(e, 43200.0, "user_id").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


