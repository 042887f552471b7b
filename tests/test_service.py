import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from barloom.ml import dataset as L, models, optimize
from barloom.operators.reconcile import fingerprint, reconcile
from barloom.service import cli, lint, report
from barloom.service.experiments import Experiments
from barloom.sources.store import BarStore
from barloom.streaming import live
from tests.conftest import rows


def test_experiments_and_reports(spark, tmp_path):
    log = Experiments(spark, str(tmp_path / "log"))
    a = log.log("backtest", "one", {"n": 1, "x": float("nan")}, {"sharpe": 1.0, "bad": float("inf")})
    b = log.log("backtest", "two", {"n": 2}, {"sharpe": 2.0, "dd": -0.1})
    assert log.list().count() == 2 and log.get(a)["config"] == {"n": 1, "x": None}
    got = {r.metric: (r[a], r[b]) for r in log.compare([a, b]).collect()}
    assert got == {"sharpe": (1.0, 2.0), "dd": (None, -0.1)}
    with pytest.raises(LookupError):
        log.get("nothing")
    t = {"runs": spark.createDataFrame([("a|b", 1.5, None)], "name string, x double, y double")}
    assert "a\\|b" in report.markdown("T", t) and json.loads(report.as_json("T", t))["tables"]["runs"][0]["x"] == 1.5
    assert "<polyline" in report.page("T<", t, {"nav": [1.0, 1.1, 0.9]}) and "T&lt;" in report.page("T<", t) and report.curve([1.0]) == ""


def test_lint(spark, tmp_path, capsys):
    bad = "def f(df):\n    x = df.x.shift(-1)\n    y = F.lead('x')\n    w.rowsBetween(0, 3)\n    ctx.now = 1\n    ctx.fly()\n    return df.bfill()\n"
    assert [(i.line, i.rule) for i in lint.lint_source(bad, frozenset({"order"}))] == [(2, "lookahead"), (3, "lookahead"), (4, "lookahead"), (5, "readonly"), (6, "context"), (7, "lookahead")]
    assert lint.lint_source("x = df.x.shift(1)\n") == [] and lint.lint_source("def (")[0].rule == "syntax"
    df = spark.range(5).withColumn("x", F.rand(1))
    w = Window.orderBy("id")
    assert lint.lint_plan(df.withColumn("y", F.lag("x").over(w))) == []
    assert lint.lint_plan(df.withColumn("y", F.lead("x").over(w))) != []
    assert lint.lint_plan(df.withColumn("y", F.sum("x").over(w.rowsBetween(-1, 1)))) == ["frame reaches ahead"]
    (tmp_path / "bad.py").write_text(bad)
    assert cli.main(["lint", str(tmp_path / "bad.py")]) == 1 and json.loads(capsys.readouterr().out)["status"] == "error"
    assert cli.coerce("3") == 3 and cli.coerce("0.5") == 0.5 and cli.coerce("True") is True and cli.coerce("x") == "x"


def test_reconcile(spark):
    t = spark.createDataFrame([("buy", 1050), ("sell", 0), ("held", 0), ("small", 50)], "symbol string, target long")
    a = spark.createDataFrame([("buy", 0, 0), ("sell", 500, 300), ("held", 500, 0), ("other", 100, 100)], "symbol string, shares long, available long")
    got = {r.symbol: (r.action, r.qty) for r in reconcile(t, a).collect()}
    assert got == {"buy": ("buy", 1000), "sell": ("sell", 300), "held": ("hold", 0), "small": ("hold", 0), "other": ("untracked", 0)}
    assert {r.symbol: r.action for r in reconcile(t, a, sell_untracked=True).collect()}["other"] == "sell"
    one = spark.range(1).select(fingerprint(F.lit("abc"), F.lit("buy"), F.lit(100.0), F.lit(1.23456))).first()[0]
    assert one == "ABC|buy|100|1.2346"


def test_optimisers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    s = np.cov(x.T)
    w = optimize.min_variance(s)
    assert w.sum() == pytest.approx(1) and (w >= -1e-9).all()
    free = np.linalg.solve(s, np.ones(5))
    free /= free.sum()
    assert (free > 0).all() and w == pytest.approx(free, abs=1e-5)
    m = optimize.mean_variance(np.array([0.5, 0, 0, 0, 0]), s)
    assert m[0] > w[0]
    r = optimize.risk_parity(s)
    part = r * (s @ r)
    assert part / part.sum() == pytest.approx(np.full(5, 0.2), abs=1e-4)


def panel(spark, n=200, signal=1.0):
    rng = np.random.default_rng(3)
    data = []
    for k in range(12):
        f = rng.normal(size=n)
        for t in range(n):
            data.append((f"s{k}", dt.date(2021, 1, 1) + dt.timedelta(days=4 * t), float(f[t]), float(signal * f[t] + rng.normal() * 0.3)))
    return spark.createDataFrame(data, "symbol string, date date, f double, label double")


def test_walk_forward_and_models(spark):
    dates = spark.createDataFrame([(dt.date(2021, 1, 1) + dt.timedelta(days=i),) for i in range(20)], "date date")
    got = rows(L.walk_forward(dates, 6, 3, 4))
    assert {r[0] for r in got} == {0, 1, 2} and sum(r[2] == "train" for r in got if r[0] == 0) == 6
    for s in (0, 1, 2):
        train, test = ([r[1] for r in got if r[0] == s and r[2] == p] for p in ("train", "test"))
        assert max(train) < min(test) and len(test) == 3
    assert L.walk_forward(dates, 30, 3, 1).count() == 0
    assert sum(r[2] == "train" for r in rows(L.walk_forward(dates, 6, 3, 4, embargo=2)) if r[0] == 0) == 4
    p = panel(spark)
    splits = L.walk_forward(p.select("date"), 100, 30, 30)
    ic = models.prediction_ic(models.predict_linear(p, splits, ["f"])).collect()[0]
    assert ic.ic_mean > 0.8
    noise = models.prediction_ic(models.predict_linear(panel(spark, signal=0.0), splits, ["f"])).collect()[0]
    assert abs(noise.ic_mean) < 0.3
    assert models.predict_linear(p, splits, ["f"], least_train=10**6).count() == 0
    y = rows(models.yearly_splits(p.select("date"), 1).groupBy("split", "part").count())
    assert {r[0] for r in y} == {2022, 2023}
    assert L.build_dataset(p.withColumn("h", F.lit(1.0)), ["f"], 3).count() == 12 * 197


def test_trees(spark):
    p = panel(spark, 60)
    splits = L.walk_forward(p.select("date"), 40, 20, 20)
    got = models.predict_trees(p, splits, ["f"], rounds=5, depth=3, rate=0.3)
    assert models.prediction_ic(got).collect()[0].ic_mean > 0.5 and got.first().importance == [1.0]


def test_stack(spark):
    wide = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, None)], "date date, a double, b double")
    assert rows(L.stack(wide, "v")) == [(dt.date(2024, 1, 1), "a", 1.0)]


def test_streams(spark, tmp_path):
    ticks = [(f"s{i % 2}", dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(seconds=50 * i), float(i)) for i in range(40)]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    batch = rows(live.bars_from_ticks(df))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ticks"))
    q = live.bars_from_ticks(stream).writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("bars")) == batch
    five = live.coarser(live.bars_from_ticks(df, "1 minute"))
    assert rows(five.select("symbol", "date", "open", "high", "low", "close", "volume")) == [r[:7] for r in batch]

    store = BarStore(spark, str(tmp_path / "store"))
    up = live.upsert_into(store)
    schema = "symbol string, date date, open double, high double, low double, close double, pre_close double, adj_factor double, updated_at timestamp"
    one = spark.createDataFrame([("a", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 0.9, 2.0, dt.datetime(2024, 1, 2)), ("a", dt.date(2024, 1, 2), 2.0, 2.0, 2.0, 2.0, 0.9, 2.0, dt.datetime(2024, 1, 3))], schema)
    up(one, 0)
    up(one, 0)
    up(one.limit(0), 1)
    late = spark.createDataFrame([("a", dt.date(2024, 1, 2), 3.0, 3.0, 3.0, 3.0, None, None, dt.datetime(2024, 1, 4))], schema)
    up(late, 2)
    assert [(r.close, r.adj_factor) for r in store.load_bars().collect()] == [(3.0, 2.0)]

    alerts = spark.createDataFrame([("k", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for s in (0, 30, 59, 61, 110, 121)], "key string, ts timestamp")
    assert [r.ts.second + 60 * r.ts.minute for r in live.first_alerts(alerts, 60.0).orderBy("ts").collect()] == [0, 61, 121]

    orders = spark.createDataFrame([("f", dt.datetime(2024, 1, 1, 0, 0, 0)), ("f", dt.datetime(2024, 1, 1, 0, 0, 30)), ("g", dt.datetime(2024, 1, 1, 0, 0, 31))], "fp string, ts timestamp")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders"))
    s = live.without_repeats(spark.readStream.schema(orders.schema).parquet(str(tmp_path / "orders")), ["fp"])
    q = s.writeStream.format("memory").queryName("orders_once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("orders_once").count() == 2


def test_portfolio_stream_is_the_batch_run(spark, tmp_path):
    from barloom.sim.desk import Desk, Settings
    from barloom.sim.strategies import DualMA

    days = pd.bdate_range("2024-01-02", periods=30)
    c = 10 + np.sin(np.arange(30) / 3)
    pdf = pd.DataFrame({"run_id": "r", "symbol": "600000.SH", "date": days, "open": c, "high": c, "low": c, "close": c, "pre_close": c, "adj_factor": 1.0})

    def make(run_id):
        return DualMA(symbols=["600000.SH"], fast=2, slow=5), Settings(carry_pending=True)

    whole = Desk(*make("r")).run(pdf.drop(columns=["run_id"]))
    schema = "run_id string, symbol string, date timestamp, open double, high double, low double, close double, pre_close double, adj_factor double"
    for i, part in enumerate((pdf.iloc[:11], pdf.iloc[11:12], pdf.iloc[12:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.portfolios(src, make).writeStream.format("memory").queryName("desk").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.kind, r.side, r.qty, r.value) for r in spark.table("desk").orderBy("at", "kind").collect()]
    want = sorted(((r[1], r[0], r[3], r[4], r[6]) for r in whole), key=lambda r: (r[0], r[1]))
    assert got == [(k, s, q, v) for _, k, s, q, v in want]
