import datetime as dt
import math
import random

import numpy as np
import pytest

from barloom.operators import spikes
from tests.conftest import rows

SCHEMA = "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double, adj_factor double, updated_at timestamp_ntz"


def day(i):
    return dt.datetime(2022, 1, 3) + dt.timedelta(days=i)


def walk(symbol, n, seed, vol=0.01):
    rng, p, out = random.Random(seed), 50.0, []
    for i in range(n):
        p *= math.exp(rng.gauss(0, vol))
        out.append([symbol, day(i), p * 0.999, p * 1.002, p * 0.998, p, 100.0, 1.0, day(i)])
    return out


def scale(bar, k):
    for i in (2, 3, 4, 5):
        bar[i] *= k


def flags(spark, bars):
    df = spark.createDataFrame([tuple(b) for b in bars], SCHEMA)
    return {(r.symbol, (dt.datetime.combine(r.date, dt.time()) - day(0)).days, r.fault_kind) for r in spikes.flag_bars(df).collect()}


@pytest.mark.parametrize("block", [16, 2048])
def test_spikes_moves_and_actions(spark, monkeypatch, block):
    monkeypatch.setattr(spikes, "BLOCK", block)
    bars = walk("a", 200, 1)
    for i in (15, 16, 17):
        scale(bars[i], 1.4)  # three rows, over a block's end
    scale(bars[60], 0.6)
    for b in bars[100:]:
        scale(b, 1.5)  # a lasting move
    for b in bars[150:]:
        scale(b, 0.5)
        b[7] = 2.0  # a split, with its factor
    bars[120][7] = 3.0  # a wrong factor moves no price
    bars[130][7] = None
    bars[150][7] = None  # the split's own factor comes a day late
    for i in (170, 171, 172, 173):
        scale(bars[i], 1.4)  # too long for an excursion
    got = flags(spark, bars)
    assert {x[1] for x in got if x[2] == "spike"} == {15, 16, 17, 60}


@pytest.mark.parametrize("block", [16, 2048])
def test_stuck_runs(spark, monkeypatch, block):
    monkeypatch.setattr(spikes, "BLOCK", block)
    bars = walk("a", 80, 2)
    for lo, n in ((13, 5), (30, 4), (50, 9), (75, 5)):
        for i in range(lo, lo + n):
            bars[i][2:6] = bars[lo][2:6]
    bars[54][6] = 0.0  # no volume breaks the run of nine
    got = {x[1] for x in flags(spark, bars) if x[2] == "stuck"}
    assert got == {13, 14, 15, 16, 17, 75, 76, 77, 78, 79}


def test_rules_repeats_and_missing_values(spark):
    bars = walk("a", 40, 3)
    bars[5][3] = bars[5][4] - 1
    bars[6][5] = bars[6][3] + 1e-7  # within the tolerance
    bars[7][5] = -1.0
    bars[8][2] = 0.0
    bars[9][5] = None
    bars[10][5] = float("nan")
    again = list(bars[11])
    again[5], again[8] = -5.0, day(11) - dt.timedelta(days=1)  # an older version
    got = flags(spark, [*bars, again, *[list(b) for b in bars[:3]], [None, day(1), *[1.0] * 6, day(1)], ["a", None, *[1.0] * 6, day(1)]])
    assert got == {("a", 5, "ohlc"), ("a", 7, "impossible"), ("a", 8, "impossible")}


def test_few_rows_constant_rows_and_none(spark):
    assert flags(spark, []) == set()
    assert flags(spark, walk("a", 1, 1) + walk("b", 3, 1)) == set()
    flat = [["c", day(i), 5.0, 5.0, 5.0, 5.0, 0.0, 1.0, day(i)] for i in range(30)]
    assert flags(spark, flat) == set()


def test_other_columns_do_no_harm(spark):
    df = spark.createDataFrame([(*b, "x", 1) for b in map(tuple, walk("a", 30, 4))], SCHEMA + ", fault_kind string, score int")
    assert rows(spikes.flag_bars(df)) == []


def test_a_law_is_recovered_from_its_bins():
    rng = np.random.default_rng(5)
    for shape, scale in ((0.3, 2.0), (-0.2, 1.0), (0.05, 0.5)):
        x = scale / shape * (rng.uniform(size=20000) ** -shape - 1)
        bins = np.floor(np.log2(x) * spikes.PER_OCTAVE)
        each = [x[bins == b] for b in np.unique(bins)]
        got = spikes.generalized_pareto(np.array([e.mean() for e in each]), np.array([float(len(e)) for e in each]))
        assert got == pytest.approx((shape, scale), abs=0.06 * max(1, scale))


def test_pooled_tail_leaves_excursions_aside():
    rng = np.random.default_rng(6)
    clean = np.sort(rng.exponential(1.0, 4000))
    dirty = np.sort(np.concatenate([clean, np.full(60, 40.0)]))
    ones = np.ones
    a, b = (spikes.tail_quantile(*spikes.pooled_tail(z, ones(len(z)))[1:]) for z in (clean, dirty))
    assert a == pytest.approx(-math.log(spikes.RISK), rel=0.35) and b == pytest.approx(a, rel=0.15)
    assert spikes.pooled_tail(np.array([]), np.array([])) is None and spikes.pooled_tail(np.array([0.0, 1.0]), np.array([5.0, 5.0])) is None


def residuals(spark, per_source):
    """Rows of (source, day, excursion, movement)."""
    data = [(s, dt.date(2022, 1, 1) + dt.timedelta(days=i), float(e), float(m)) for s, (es, ms) in per_source.items() for i, (e, m) in enumerate(zip(es, ms))]
    return spark.createDataFrame(data, "__src string, __day date, __e double, __move double")


def test_every_source_has_its_own_cutoff_and_short_ones_that_of_all(spark):
    rng = np.random.default_rng(7)
    n = 6000
    calm = {f"calm{i}": (0.01 * rng.uniform(0, 2, n), np.abs(rng.normal(0, 0.01, n))) for i in range(4)}
    wild = {f"wild{i}": (0.03 * np.abs(rng.standard_t(3, n)), np.abs(rng.normal(0, 0.01, n))) for i in range(4)}
    short = {"short": (np.concatenate([0.01 * rng.uniform(0, 2, 12), [5.0]]), np.abs(rng.normal(0, 0.01, 13)))}
    still = {"still": (np.zeros(20), np.zeros(20))}
    got = {r["__s"]: r["__cutoff"] / r["__usual"] for r in spikes.tail_cutoffs(residuals(spark, calm | wild | short | still)).collect()}
    assert set(got) == {*calm, *wild, *short}
    # uniform residuals end at 2 usual movements, those of the wild ones go on: no constant serves both
    assert all(1.9 < got[s] < 4 for s in calm) and all(got[s] > 12 for s in wild)
    assert 4 < got["short"] < min(got[s] for s in wild) and got["short"] * 0.01 < 5.0


def test_weekdays_differ_only_where_they_do(spark):
    rng = np.random.default_rng(8)
    n = 2800
    days = [dt.date(2022, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    calm = np.abs(rng.normal(0, 0.01, n))
    busy = calm * np.array([8.0 if d.weekday() == 0 else 1.0 for d in days])
    even = spikes.tail_cutoffs(residuals(spark, {"a": (calm, calm)})).first()
    odd = spikes.tail_cutoffs(residuals(spark, {"a": (busy, busy)})).first()
    assert max(even["__season"]) < 1.15 * min(even["__season"])
    assert odd["__season"][1] > 5 * max(x for i, x in enumerate(odd["__season"]) if i != 1)  # Mondays


def test_gaps_at_the_end_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK", 64)
    bars = walk("a", 260, 9)
    for i in range(56, 65):
        bars[i][5] = None
    scale(bars[65], 1.5)  # behind nine missing prices and the end of a block
    for i in range(110, 140):
        bars[i][7] = None  # the factor is missing for longer than a block sees
    for b in bars[140:]:
        scale(b, 0.5)
        b[7] = 2.0
    assert {x[1] for x in flags(spark, bars) if x[2] == "spike"} == {65}
