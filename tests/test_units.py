import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.units import plain_number, split_number, unit_power
from barloom.operators.units import edges, scale_and_offset, snap_graph
from barloom.plans.problems import BarUnits
from tests.conftest import rows


def test_reading_numbers(spark):
    texts = ["1,234.5手", "１２３ 万股", " 2.5e+3 k shares", "-", "N/A", "", None, "12 furlongs", "1.5e-2", "0.3億元", "7\t", "+4 lots", "1,23"]
    got = {i: (*split_number(t or ""), None) for i, t in enumerate(texts)}
    units = spark.createDataFrame([(i, x[1]) for i, x in got.items()], "i int, u string")
    got = {r.i: (*got[r.i][:2], r.p) for r in units.select("i", F.coalesce(unit_power("volume", "u"), unit_power("amount", "u")).alias("p")).collect()}
    assert got[0] == (1234.5, "手", 0) and got[1] == (123.0, "万股", 2) and got[2] == (2500.0, "k shares", 1)
    assert [got[i][0] for i in (3, 4, 5, 6)] == [None] * 4
    assert got[7][2] is None and got[8][0] == 0.015 and got[9][2] == 8 and got[10][:2] == (7.0, "") and got[11] == (4.0, "lots", 0)
    assert got[12][1] != ""


def test_graph_reaches_nodes_behind_nodes():
    powers = {"v": {-2, 0, 2}}
    h = [("b", False, "a", True, "v", 2.0, 100), ("c", False, "b", False, "v", -2.0, 50), ("d", False, "a", True, "v", 0.9, 30), ("b", False, "a", True, "v", 0.02, 1)]
    found = snap_graph(h, powers)
    assert found["b", "v"] == {-2: 100, 0: 1}
    assert found["c", "v"] == {0: pytest.approx(50 * 100 / 101), 2: pytest.approx(50 / 101)}
    assert ("d", "v") not in found


def test_units_are_composed_of_a_multiple_and_a_base(spark):
    texts = ["十万股", "10 k shares", "百萬元", "100mn CNY", "billion yuan", "千手", "百亿", "hundred", "万", "k", "万千股", "千千股", "股万"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [(r.v, r.a) for r in df.select("i", unit_power("volume", "t").alias("v"), unit_power("amount", "t").alias("a")).orderBy("i").collect()]
    assert got == [(3, None), (2, None), (None, 6), (None, 8), (None, 9), (3, None), (None, 10), (None, 2), (None, 4), (None, 3), (None, None), (None, None), (None, None)]


def test_plain_numbers_are_read_as_all_are(spark):
    texts = ["12", " 1.5", "-3e4", "+7.", "1e-3", "NaN", "inf", "1d", "0x1p3", "1,234", "", None, "1 2", "１２", "5\t", ".5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("t", plain_number("t").alias("p")).collect()
    assert [r.p for r in got] == [12.0, 1.5, -30000.0, None, 0.001, *[None] * 10, 0.5]
    assert all(split_number(r.t) == (r.p, "") for r in got if r.p is not None and r.t != ".5")


def test_scale_and_offset_by_medians():
    rng = np.random.default_rng(1)
    b = 10 ** rng.uniform(2, 4, 4000)
    for scale, offset in ((100.0, 0.0), (1.0, 300.0), (0.01, -80.0), (10.0, 20.0)):
        a = scale * (b + offset)
        a[::10] *= 7  # a tenth is wrong
        hist = np.round((np.log10(np.maximum(a, 1e-12)) - np.log10(b)) * 200) / 200
        s, o = scale_and_offset((np.floor(np.log10(b) * 4) + 0.5) / 4, hist, np.ones(4000))
        assert np.log10(s) == pytest.approx(np.log10(scale), abs=0.05) and o == pytest.approx(offset if abs(offset) > 20 else 0.0, rel=0.2)
    links = [("x", False, "y", True, "v", -2.0, 4, 30), ("x", False, "y", True, "v", -2.0, 6, 30), ("x", False, "y", True, "v", 0.0, 4, 5)]
    found, offsets = edges(links)
    assert sorted(e[5:] for e in found) == [(-2.0, 60), (0.0, 5)] and offsets == {}


UNITS = [("s", "volume", "lot", None, dt.date(2022, 7, 1)), ("s", "volume", "share", dt.date(2022, 7, 1), None), ("s", "amount", "yuan", None, None), ("s", "turnover_rate", "percent", None, None), ("k", "amount", "yuan", None, None)]


def resolve(spark, deliveries, floats=(("1", 1_000_000),)):
    units = BarUnits()
    units.entity = ["sym", "date"]
    d = spark.createDataFrame(deliveries, "delivery_id long, source string, sym string, date date, close double, volume string, volume_unit string, amount string, amount_unit string, turnover_rate string, turnover_unit string, fetched_at timestamp_ntz")
    known = spark.createDataFrame(UNITS, "source string, field string, unit string, valid_from date, valid_to date")
    f = spark.createDataFrame(list(floats), "sym string, float_shares long")
    out = units.harmonize(d, known, context=f, context_key="sym", keep=["close"])
    return {r.delivery_id: (r.p_volume, r.p_amount, r.p_turnover_rate) for r in out.collect()}


def row(i, source, v, a, t, *, vu=None, au=None, tu=None, sym="1", day=1, at=dt.datetime(2022, 7, 1), close=10.0):
    return (i, source, sym, dt.date(2022, 6, day), close, v, vu, a, au, t, tu, at)


def test_order_of_evidence(spark):
    early = dt.datetime(2022, 6, 30, 23, 59)
    got = resolve(spark, [
        row(1, "s", "5 万手", "1", "1", vu="lot"),  # beside the number
        row(2, "s", "500", "5", "1", vu="手", au="万元", tu="‰"),  # the row's columns
        row(3, "s", "500", "5", "1"),  # the feed, from its day on
        row(4, "s", "500", "5", "1", at=early),  # the feed, before it
        row(5, "s", "-", None, "x"),
    ])
    assert got == {1: (4, 0, 0), 2: (0, 4, -1), 3: (-2, 0, 0), 4: (0, 0, 0), 5: (None, None, None)}


def test_figures_of_the_row_choose(spark):
    # 100 lots at 10 are 100,000 yuan and 1 percent of 1,000,000 shares
    data = [row(i, "s", "10000", "100000", "1", day=i) for i in range(1, 9)]
    data += [row(10 + i, "k", "100", "100000", "1.0", day=i) for i in range(1, 5)]
    data += [row(20 + i, "k", "10000", "100000", "0.01", day=i) for i in range(5, 9)]
    data += [row(30, "k", "10000", "-", "-", day=1), row(31, "k", "100", None, None, day=2), row(32, "k", None, None, "0.01", day=3), row(33, "k", None, "0", "1", day=9)]
    got = resolve(spark, data)
    assert all(got[10 + i] == (0, 0, 0) for i in range(1, 5))
    assert all(got[20 + i] == (-2, 0, 2) for i in range(5, 9))
    assert got[30][0] == -2 and got[31][0] == 0 and got[32][2] == 2  # by the values linked to the same entity
    assert got[33][2] is not None


def test_figures_of_the_row_outweigh_rare_units(spark):
    data = [row(100 * k + i, "s", "10000", "100000", "1", day=i, sym=str(k)) for k in (1, 2) for i in range(1, 31)]
    data += [row(1000 + 100 * k + i, "k", "100", "100000", None, day=i, sym=str(k)) for k in (1, 2) for i in range(2, 31)]
    data += [row(1, "k", "1", "100000", None), row(2, "k", "1", "100000", None, sym="lonely"), row(3, "k", "1", "100000", "1", sym="3"), row(4, "k", "1", None, None, sym="lonely", day=2), row(5, "k", "100", "100000", None, sym="lonely", day=3)]
    got = resolve(spark, data, floats=[(x, 1_000_000) for x in "123"])
    assert got[1][0] == 2  # under two percent of the links show 10,000 shares
    assert got[2][0] == got[3][0] == 2 and got[3][2] == 0  # no other source delivers these
    assert got[4][0] == 0 and got[5][0] == 0  # without other figures, and in the usual unit
    assert all(got[1000 + 100 * k + i][0] == 0 for k in (1, 2) for i in range(2, 31))


def test_nulls_anywhere_repeats_and_other_columns(spark):
    odd = (40, None, None, None, None, "5手", None, "-", None, None, None, None)
    data = [row(1, "s", "500", "5", "1"), row(1, "s", "500", "5", "1"), odd, row(41, "k", "10000", "100000", None, close=None), row(42, "new", "7", "8", "9", sym="nobody")]
    got = resolve(spark, data)
    assert got[1] == (-2, 0, 0) and got[40] == (0, None, None) and got[41][0] is not None
    assert all(p is not None for p in got[42])  # a feed without links has all conversions to choose from
    units = BarUnits()
    units.entity = ["sym", "date"]
    d = spark.createDataFrame([data[0]], "delivery_id long, source string, sym string, date date, close double, volume string, volume_unit string, amount string, amount_unit string, turnover_rate string, turnover_unit string, fetched_at timestamp_ntz")
    d = d.selectExpr("*", "1 as n_volume", "'x' as p_volume", "2 as __on", "3 as float_shares")
    known = spark.createDataFrame(UNITS, "source string, field string, unit string, valid_from date, valid_to date")
    assert units.harmonize(d, known, context=spark.createDataFrame([("1", 5)], "sym string, float_shares long"), context_key="sym", keep=["close"]).count() == 1


def test_empty(spark):
    assert resolve(spark, []) == {}


def test_each_evidence_decides_what_the_others_leave_open(spark):
    """Figures of the row, then linked values, then the uses of the source: without one of them, its rows change."""
    data = [row(i, "s", "10000", "100000", "1", day=i) for i in range(1, 29)]
    data += [row(100 + i, "k", "10000" if i % 4 else "100", None, None, day=i) for i in range(1, 25)]  # linked only
    data += [row(200, "k", "777", None, None, sym="2"), row(201, "k", "10000", "10000000", None, sym="2", day=2)]  # nothing but the source's uses; its own figures
    whole = resolve(spark, data)
    assert all(whole[100 + i][0] == (-2 if i % 4 else 0) for i in range(1, 25))
    assert whole[200][0] == -2 and whole[201][0] == 0
    lone = resolve(spark, [r for r in data if r[0] > 100])  # no links, no uses: only the figures still decide
    assert lone[201][0] == 0
    units = BarUnits(figures=False)
    units.entity = ["sym", "date"]
    d = spark.createDataFrame(data, "delivery_id long, source string, sym string, date date, close double, volume string, volume_unit string, amount string, amount_unit string, turnover_rate string, turnover_unit string, fetched_at timestamp_ntz")
    known = spark.createDataFrame(UNITS, "source string, field string, unit string, valid_from date, valid_to date")
    linked = {r.delivery_id: r for r in units.harmonize(d, known, keep=["close"]).collect()}
    assert all(linked[100 + i].p_volume == (-2 if i % 4 else 0) and linked[100 + i].l_volume for i in range(1, 25))
    assert linked[201].p_volume == -2 and not linked[201].l_volume  # the graph alone takes the usual conversion


def test_an_offset_of_a_source_is_taken_off(spark):
    value = [round(500 * 1.04**i) for i in range(75)]
    data = [row(1000 + i, "s", str(100 * v), "100000", None, day=i % 28 + 1, sym=str(i // 28)) for i, v in enumerate(value)]
    data += [row(2000 + i, "k", str(v + 400), None, None, day=i % 28 + 1, sym=str(i // 28)) for i, v in enumerate(value)]
    units = BarUnits(figures=False)
    units.entity = ["sym", "date"]
    d = spark.createDataFrame(data, "delivery_id long, source string, sym string, date date, close double, volume string, volume_unit string, amount string, amount_unit string, turnover_rate string, turnover_unit string, fetched_at timestamp_ntz")
    known = spark.createDataFrame(UNITS, "source string, field string, unit string, valid_from date, valid_to date")
    got = {r.delivery_id: r.v_volume for r in units.harmonize(d, known, keep=["close"]).collect()}
    assert all(got[2000 + i] == pytest.approx(v, rel=0.25) and got[1000 + i] == pytest.approx(v) for i, v in enumerate(value))
