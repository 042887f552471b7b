import datetime as dt

import pytest

from barloom.operators.quality import InvalidBars, validate_bars
from barloom.sources import feeds as FD, standardize as Z
from barloom.sources.store import BarStore, ReadOnlyStore
from tests.conftest import rows

SCHEMA = "symbol string, date date, open double, high double, low double, close double, pre_close double, volume double, amount double, adj_factor double"


def d(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def bars(spark, symbol="600000.SH", n=5, base=10.0, factor=lambda i: 1.0, first=0, **kw):
    data = []
    for i in range(first, first + n):
        c = base + 0.1 * i
        data.append((symbol, d(i), c - 0.05, c + 0.1, c - 0.12, c, None if i == first else c - 0.1, 1e5, c * 1e5, factor(i)))
    return spark.createDataFrame(data, SCHEMA)


def test_round_trip_update_and_adjustment(spark, tmp_path):
    s = BarStore(spark, str(tmp_path / "s"))
    assert s.symbols() == [] and s.incremental_start(["600000.SH"]) == dt.date(1990, 1, 1)
    assert s.save_bars(bars(spark, factor=lambda i: 1.0 + i / 4), source="test") == 5
    assert s.symbols() == ["600000.SH"] and s.provenance()["source"] == "test"
    assert s.last_dates().collect()[0].last_date == d(4)
    before = rows(s.load_bars(columns=["date", "close", "pre_close"]))
    assert s.update_bars(bars(spark, factor=lambda i: 1.0 + i / 4)) == 5 and rows(s.load_bars(columns=["date", "close", "pre_close"])) == before
    new = bars(spark, n=2, first=4, base=20.0).selectExpr("symbol", "date", "open", "high", "low", "close", "null as pre_close", "volume", "null as amount", "null as adj_factor")
    assert s.update_bars(new) == 6
    got = {r.date: r for r in s.load_bars().collect()}
    assert got[d(4)].close == pytest.approx(20.4) and got[d(4)].adj_factor == 2.0 and got[d(4)].pre_close == pytest.approx(10.3)
    assert got[d(1)].pre_close == pytest.approx(10.0) and got[d(5)].adj_factor is None
    q = {r.date: r.close for r in s.load_bars(end=str(d(2)), adjusted="qfq").collect()}
    assert q[d(0)] == pytest.approx(10.0 / 2.0)  # the factor of the full history
    assert {r.date for r in s.load_bars(start=str(d(1)), end=str(d(2))).collect()} == {d(1), d(2)}
    with pytest.raises(KeyError):
        s.load_bars(columns=["nothing"])
    assert s.incremental_start(["600000.SH"]) == d(6) and s.incremental_start(["600000.SH", "x"]) == dt.date(1990, 1, 1)


def test_snapshots_stay(spark, tmp_path):
    s = BarStore(spark, str(tmp_path / "s"))
    s.save_bars(bars(spark))
    s.save_calendar(spark.createDataFrame([(d(1),), (d(0),), (d(1),), (None,)], "date date"))
    s.save_instruments(spark.createDataFrame([("600000.SH", "bank"), ("600000.SH", "bank"), (None, "x")], "symbol string, name string"))
    assert s.load_calendar().count() == 2 and s.load_instruments().count() == 1
    assert [r.symbol for r in s.search_instruments("60").collect()] == ["600000.SH"]
    s.create_snapshot("v1")
    s.save_bars(bars(spark, base=99.0))
    old = BarStore(spark, str(tmp_path / "s"), "v1")
    assert old.load_bars().agg({"close": "max"}).first()[0] < 20 and s.load_bars().agg({"close": "max"}).first()[0] > 90
    with pytest.raises(ReadOnlyStore):
        old.save_bars(bars(spark))
    with pytest.raises(FileExistsError):
        s.create_snapshot("v1")
    with pytest.raises(ValueError):
        s.create_snapshot("../x")
    assert s.list_snapshots() == ["v1"]
    s.delete_snapshot("v1")
    assert s.list_snapshots() == []


def test_validation(spark):
    good = bars(spark)
    assert validate_bars(good).columns[:6] == ["symbol", "date", "open", "high", "low", "close"] and validate_bars(good.limit(0)).count() == 0
    with pytest.raises(InvalidBars) as e:
        validate_bars(good.selectExpr("symbol", "date", "open", "high", "high + 1 as low", "cast(close as string) || 'x' as close"))
    assert set(e.value.problems) == {"unreadable close", "missing close", "broken prices"}
    with pytest.raises(InvalidBars):
        validate_bars(good.drop("close"))
    with pytest.raises(ValueError):
        validate_bars(good, "1w")


def test_corporate_actions(spark):
    schema = "symbol string, date date, category int, cash double, bonus double, rights double, rights_price double, ratio double"
    flat = spark.createDataFrame([("s", d(i), 20.0, 20.0, 20.0, 20.0, 20.0, 1.0, 1.0, 1.0) for i in range(4)], SCHEMA)

    def run(*events):
        out = Z.apply_events(flat, spark.createDataFrame(list(events), schema))
        return {r.date: (r.adj_factor, r.pre_close) for r in out.collect()}

    got = run(("s", d(2), 1, 5.0, None, None, None, None))
    assert got[d(1)] == (1.0, 20.0) and got[d(2)] == (pytest.approx(20 / 19.5), pytest.approx(19.5)) and got[d(3)][1] == 20.0
    assert run(("s", d(2), 1, None, 10.0, None, None, None))[d(2)] == (2.0, 10.0)
    assert run(("s", d(2), 1, None, 10.0, None, None, None), ("s", d(3), 1, None, 10.0, None, None, None))[d(3)][0] == 4.0
    assert run(("s", d(2), 11, None, None, None, None, 0.001))[d(2)][0] == 1.0
    assert run(("s", d(2), 11, None, None, None, None, 0.5))[d(2)] == (0.5, 40.0)
    assert run(("s", d(0), 1, 5.0, None, None, None, None), ("s", d(99), 1, 5.0, None, None, None, None))[d(3)][0] == 1.0


def test_day_files_and_feeds(spark, tmp_path):
    import numpy as np

    a = np.array([(20240102, 1000, 1010, 990, 1005, 5e5, 500, 0), (20240103, 1005, 1020, 1000, 1015, 6e5, 600, 0), (99999999, 1, 1, 1, 1, 1, 1, 0)], dtype=FD.RECORD)
    (tmp_path / "sh600000.day").write_bytes(a.tobytes() + b"torn")
    want = [("600000.SH", dt.date(2024, 1, 2), 10.0, 10.1, 9.9, 10.05, 500.0, 5e5), ("600000.SH", dt.date(2024, 1, 3), 10.05, 10.2, 10.0, 10.15, 600.0, 6e5)]
    assert rows(FD.read_day_files(spark, str(tmp_path / "*.day"))) == want
    spark.dataSource.register(FD.DayFileSource)
    assert rows(spark.read.format("day_files").option("path", str(tmp_path / "*.day")).load()) == want
    root = tmp_path / "landed"
    bars(spark).write.parquet(str(root / "1d"))
    good, none = FD.LandedFeed("good", str(root)), FD.LandedFeed("none", str(tmp_path / "nowhere"))
    name, df = FD.with_fallback([none, good], lambda f: f.bars(spark, ["600000.SH"], str(d(1)), str(d(3))))
    assert name == "good" and df.count() == 3
    with pytest.raises(FD.FeedError) as e:
        FD.with_fallback([good], lambda f: f.bars(spark, [], "2024-01-01", "2024-01-02"))
    assert e.value.code == "PARAM"
    FD.register_feed("landed-test", FD.LandedFeed)
    with pytest.raises(ValueError):
        FD.register_feed("landed-test", FD.LandedFeed)
    assert "landed-test" in FD.feeds() and FD.create_feed("landed-test", name="x", root="y").name == "x"
