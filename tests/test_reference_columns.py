"""Closed-form cases of the column operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.functions import cross as X, market as K, series as S
from barloom.operators import analysis as A, metrics as M, vectorized as V
from barloom.operators.ewm import recursive
from tests.conftest import rows


def d(i, start=dt.date(2024, 1, 1)):
    return start + dt.timedelta(days=i)


def line(spark, **cols):
    n = len(next(iter(cols.values())))
    data = [("s", d(i), *[None if c[i] is None else float(c[i]) for c in cols.values()]) for i in range(n)]
    return spark.createDataFrame(data, "symbol string, date date, " + ", ".join(f"{c} double" for c in cols))


def values(df, *cols):
    out = df.select("date", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).orderBy("date").collect()
    got = [[r[f"c{i}"] for r in out] for i in range(len(cols))]
    return got[0] if len(cols) == 1 else got


@pytest.fixture(autouse=True)
def _columns(spark):
    global W, x
    W, x = S.line("symbol"), F.col("x")


def test_rolling_and_lags(spark):
    df = line(spark, x=[1, 2, 3, 4, 5])
    assert values(df, S.sma(x, 3, W)) == [None, None, 2, 3, 4]
    assert values(df, S.ref(x, 1, W))[:2] == [None, 1]
    assert values(df, S.hhv(x, 2, W), S.llv(x, 2, W)) == [[None, 2, 3, 4, 5], [None, 1, 2, 3, 4]]
    gap = line(spark, x=[1, None, 3, 4, 5])
    assert values(gap, S.sma(x, 2, W)) == [None, None, None, 3.5, 4.5]
    assert values(gap, S.change(x, W))[1:3] == [0.0, 2.0]
    assert values(line(spark, x=[0, 1]), S.roc(x, 1, W)) == [None, None]


def test_cross(spark):
    df = line(spark, a=[0, 1, 2, 3], b=[1, 1, 1, 1])
    assert values(df, S.cross(F.col("a"), F.col("b"), W)) == [False, False, True, False]
    assert values(line(spark, a=[2, 1, 0, None], b=[1, 1, 1, 1]), S.cross_down(F.col("a"), F.col("b"), W)) == [False, False, True, False]


def test_atr(spark):
    df = line(spark, h=[11, 12, 13], l=[9, 10, 11], c=[10, 11, 12]).withColumn("tr", S.true_range(F.col("h"), F.col("l"), F.col("c"), W))
    assert values(df, S.sma(F.col("tr"), 2, W)) == [None, 2, 2]


def test_recursive_indicators(spark):
    up, flat = line(spark, close=range(1, 31), high=range(1, 31), low=range(1, 31)), line(spark, close=[5] * 30, high=[5] * 30, low=[5] * 30)
    assert [r.r for r in recursive(up, {"r": ("rsi", 14)}).orderBy("date").collect()][1:] == [100.0] * 29
    assert [r.r for r in recursive(flat, {"r": ("rsi", 14)}).orderBy("date").collect()][1:] == [50.0] * 29
    k = recursive(flat, {"k": ("kdj", 9, 3)}).collect()
    assert all(r.k_k is None and r.k_d is None and r.k_j is None for r in k)
    gaps = line(spark, close=[None, 1, None, None, 3, 4])
    got = [r.e for r in recursive(gaps, {"e": ("ewm", 0.5)}).orderBy("date").collect()]
    assert got[0] is None and got[1:] == pytest.approx([1, 1, 1, 2.6, 3.3])


def test_roll_factor(spark):
    df = line(spark, x=[100, 101, 102, 110, 105.5, 106])
    got = values(df, S.roll_factor(x, 0.05, W))
    assert got == pytest.approx([1, 1, 1, 102 / 110, 102 / 110, 102 / 110])


def section(spark, xs, ys=None):
    ys = ys or [None] * len(xs)
    return spark.createDataFrame([(f"s{i}", d(0), None if a is None else float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(xs, ys))], "symbol string, date date, x double, y double")


def cells(df, c):
    return [r.v for r in df.select("symbol", c.alias("v")).orderBy("symbol").collect()]


def test_cross_sections(spark):
    assert cells(section(spark, [10, 30, 20]), X.rank_pct(x, ["date"])) == pytest.approx([1 / 3, 1, 2 / 3])
    assert cells(section(spark, [1, 1, None, 3]), X.rank_average(x, ["date"])) == [1.5, 1.5, None, 3.0]
    assert cells(section(spark, [5, 5, 5]), X.zscore(x, ["date"])) == [None] * 3
    y = F.col("y")
    fit = cells(section(spark, [1, 2, 3, 4], [1, 5, 2, 8]), X.residual(y, x, ["date"]))
    assert sum(fit) == pytest.approx(0) and sum(a * b for a, b in zip(fit, [1, 2, 3, 4])) == pytest.approx(0)
    assert cells(section(spark, [1, None, 3, 4], [1, 5, 2, 8]), X.residual(y, x, ["date"])) == [None] * 4
    assert cells(section(spark, [1, 2, 3, 4, 5]), X.quantile_group(X.rank_pct(x, ["date"]), 5)) == [1, 2, 3, 4, 5]


def test_weights(spark):
    w = rows(V.weights_from_factor(section(spark, [1, 2, 3, 4, 5]), "x").select("symbol", "weight"))
    assert w == [("s0", -0.5), ("s1", None), ("s2", None), ("s3", 0.25), ("s4", 0.25)]
    assert all(r[1] is None for r in rows(V.weights_from_factor(section(spark, [1, 2]), "x").select("symbol", "weight")))
    with pytest.raises(ValueError):
        V.weights_from_factor(section(spark, [1, 2]), "x", top=0.7, bottom=0.7)


def panel(spark, prices, weights):
    data = [(s, d(i), float(p), w[i]) for s, (ps, w) in {k: (prices[k], weights[k]) for k in prices}.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(data, "symbol string, date date, h double, weight double")
    return df.select("symbol", "date", "weight"), df.select("symbol", "date", "h")


def test_backtest(spark):
    w, p = panel(spark, {"a": [10, 11, 12, 13], "b": [10, 10, 10, 10]}, {"a": [0.5] * 4, "b": [-0.5] * 4})
    got = V.portfolio(w, p).orderBy("date").collect()
    assert [r.turnover for r in got] == pytest.approx([0, 0.5, 0, 0])
    w, p = panel(spark, {"a": [10, 11, 12]}, {"a": [None, None, 1.0]})
    assert [r.nav for r in V.portfolio(w, p).orderBy("date").collect()] == [1.0, 1.0, 1.0]  # a weight of the last day sees no return
    with pytest.raises(ValueError):
        V.portfolio(w, p, lag=0)


def test_drift_is_renormalised(spark):
    w = spark.createDataFrame([("a", d(0), 0.5), ("b", d(0), 0.5)], "symbol string, date date, target double")
    r = spark.createDataFrame([("a", d(0), 0.1), ("a", d(1), 0.0), ("a", d(2), 0.2), ("b", d(0), 0.0), ("b", d(1), None), ("b", d(2), 0.0)], "symbol string, date date, ret double")
    got = {(x.symbol, x.date): x.weight for x in V.drifted(w, r).collect()}
    assert got["a", d(0)] == 0.5 and got["a", d(1)] == pytest.approx(0.55 / 1.05) and got["a", d(2)] == pytest.approx(0.55 / 1.05)


def navs(spark, xs, dates=None):
    return spark.createDataFrame([("r", dates[i] if dates else d(i), float(v)) for i, v in enumerate(xs)], "run string, date date, nav double")


def test_metrics(spark):
    m = M.summarize(navs(spark, [100, 110, 99, 121]), ["run"]).collect()[0]
    assert m.total_return == pytest.approx(0.21) and m.max_drawdown == pytest.approx(-0.1) and m.daily_win_rate == pytest.approx(2 / 3)
    assert m.calmar == pytest.approx(m.annual_return / 0.1)
    one = M.summarize(navs(spark, [100]), ["run"]).collect()[0]
    assert (one.total_return, one.annual_return, one.sharpe, one.sortino, one.daily_win_rate) == (0, 0, 0, 0, 0)
    s = M.streaks(navs(spark, [100, 101, 102, 103, 101.97, 100.95]), ["run"]).collect()[0]
    assert (s.max_win_days, s.max_loss_days) == (3, 2)


def test_alpha_beta(spark):
    rb = [0.01, -0.02, 0.015, 0.003, -0.007]
    a, b = [1.0], [1.0]
    for r in rb:
        a.append(a[-1] * (1 + 1.5 * r))
        b.append(b[-1] * (1 + r))
    bench = spark.createDataFrame([(d(i), v) for i, v in enumerate(b)], "date date, bench double")
    got = M.alpha_beta(navs(spark, a), bench, ["run"]).collect()[0]
    assert got.beta == pytest.approx(1.5) and got.alpha == pytest.approx(0, abs=1e-9)


def test_trades_and_months(spark):
    t = spark.createDataFrame([("r", None, False, 1.0, 100.0), ("r", 100.0, True, 1.0, 100.0), ("r", -50.0, True, 1.0, 100.0), ("r", 20.0, True, 1.0, 100.0)], "run string, pnl double, closing boolean, fees double, value double")
    s = M.trade_stats(t, ["run"]).collect()[0]
    assert s.trade_win_rate == pytest.approx(2 / 3) and s.profit_factor == pytest.approx(2.4)
    days = [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 2, 2), dt.date(2024, 2, 5), dt.date(2024, 2, 6)]
    got = dict(rows(M.period_returns(navs(spark, [100, 110, 121, 121, 110, 99], days), ["run"], F.date_format("date", "yyyy-MM")).select("period", "ret")))
    assert got["2024-01"] == pytest.approx(0.10) and got["2024-02"] == pytest.approx(99 / 110 - 1)


def test_a_factor_that_knows_the_future_shows(spark):
    data = [(f"s{i}", d(t), 10 + i + 0.6 * math.sin(2 * math.pi * (t + 2.5 * i) / 9) + 0.02 * t) for i in range(8) for t in range(60)]
    df = spark.createDataFrame(data, "symbol string, date date, h double").withColumn("fwd", A.forward(F.col("h"), 1)).withColumn("value", F.col("fwd"))
    assert A.ic_summary(A.rank_ic(df)).collect()[0].ic_mean > 0.95
    flat = df.withColumn("value", F.lit(1.0))
    assert A.rank_ic(flat).count() == 0


def test_market_rules(spark):
    s = spark.createDataFrame([("RB2505.SHFE",), ("TA505.CZCE",), ("IF2412.CFE",), ("RB.SHFE",), ("RB2513.SHFE",), ("510300.SH",), ("513100.SH",), ("159941.SZ",), ("600000.SH",), ("AAPL.NASDAQ",), ("60000.SH",), ("foo",)], "symbol string")
    c = F.col("symbol")
    got = {r.symbol: (r.e, r.t, r.v) for r in s.select("symbol", K.contract_expiry(c).alias("e"), K.is_same_day(c).alias("t"), K.is_valid_symbol(c).alias("v")).collect()}
    assert got["RB2505.SHFE"][0] == dt.date(2025, 5, 15) and got["TA505.CZCE"][0] == dt.date(2025, 5, 15) and got["IF2412.CFE"][0] == dt.date(2024, 12, 20)
    assert got["RB.SHFE"][0] is None and got["RB2513.SHFE"][0] is None
    assert [got[k][1] for k in ("510300.SH", "513100.SH", "159941.SZ", "600000.SH", "RB.SHFE")] == [False, True, True, False, True]
    assert [got[k][2] for k in ("AAPL.NASDAQ", "60000.SH", "foo", "RB.SHFE")] == [True, False, False, True]
    one = spark.range(1)
    fee = one.select(K.futures_fees(F.lit(0.0), F.lit(5000.0), F.lit(2000.0))).first()[0]
    assert fee == pytest.approx(3000 * 1e-4 + 2000 * 5e-4)
    assert one.select(K.round_cents(F.lit(1.005))).first()[0] == 1.0
    assert one.select(K.stock_fees(F.lit(1000.0), F.lit("sell"))).first()[0] == pytest.approx(5 + 0.5 + 0.01)
    spec = K.with_contract(s).where("symbol = 'RB.SHFE'").collect()[0]
    assert (spec.multiplier, spec.margin) == (10.0, 0.13)
