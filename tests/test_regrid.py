import datetime as dt
import random

import pandas as pd

from barloom.operators.regrid import regularize, regularize_steps
from tests.conftest import rows


def d(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def brute(readings, grid):
    out = []
    for s in sorted({r[0] for r in readings if r[0] is not None and r[1] is not None}):
        mine = {}
        for src, day, v, ver in sorted((r for r in readings if r[0] == s and r[1] is not None), key=lambda r: r[3]):
            mine[day] = v
        first, last = min(mine), max(mine)
        seen, carried = None, None
        for day in pd.date_range(first, last).date:
            if day in mine:
                seen, carried = day, carried if mine[day] is None else mine[day]
            if day in grid:
                out.append((s, day, day not in mine, mine.get(day), carried, (day - seen).days))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    readings = []
    for s in "abc":
        for i in sorted(rng.sample(range(120), 25)):
            readings.append((s, d(i), rng.choice([None, float(rng.randint(1, 9))]), 1))
        readings.append((s, readings[-1][1], 77.0, 2))
    readings += [("one", d(5), 1.0, 1), (None, d(3), 1.0, 1), ("a", None, 1.0, 1)]
    grid = [d(i) for i in range(0, 130) if i % 7 < 5]
    df = spark.createDataFrame(readings, "src string, at date, v double, ver int")
    days = spark.createDataFrame([(x,) for x in grid] + [(grid[0],), (None,)], "date date")
    for shard in (5, 91):
        got = rows(regularize(df, days, "src", "at", ["v"], version="ver", shard_days=shard))
        assert got == sorted(brute(readings, set(grid)), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_empty_and_nan_and_clashes(spark):
    days = spark.createDataFrame([(d(i),) for i in range(4)], "date date")
    empty = spark.createDataFrame([], "src string, at date, v double")
    assert rows(regularize(empty, days, "src", "at", ["v"])) == []
    df = spark.createDataFrame([("a", d(0), 1.0, "x"), ("a", d(1), float("nan"), "x"), ("a", d(3), 2.0, "x")], "src string, at date, v double, is_missing string")
    assert rows(regularize(df, days, "src", "at", ["v"])) == [("a", d(0), False, 1.0, 1.0, 0), ("a", d(1), False, None, 1.0, 0), ("a", d(2), True, None, 1.0, 1), ("a", d(3), False, 2.0, 2.0, 0)]
    assert rows(regularize(df, days.limit(0), "src", "at", ["v"])) == []


def test_steps_of_seconds(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 23, 59, 0) + dt.timedelta(seconds=s)
    data = [("a", t(1), 1.0, 5), ("a", t(4), 2.0, 5), ("a", t(61), None, 5), ("a", t(185), float("nan"), 5), ("a", t(241), 9.0, 5), ("b", t(30), 3.0, 5), ("b", None, 4.0, 5), (None, t(3), 4.0, 5)]
    df = spark.createDataFrame(data, "src string, ts timestamp, value double, is_missing int")
    for shard in (2, 512):
        got = {(r.src, r.ts): tuple(r)[2:] for r in regularize_steps(df, "src", "ts", ["value"], 60, shard_steps=shard).collect()}
        assert got == {("a", t(0)): (False, 2.0, 2.0, 0), ("a", t(60)): (False, None, 2.0, 0), ("a", t(120)): (True, None, 2.0, 1), ("a", t(180)): (False, None, 2.0, 0), ("a", t(240)): (False, 9.0, 9.0, 0), ("b", t(0)): (False, 3.0, 3.0, 0)}
    assert regularize_steps(df.limit(0), "src", "ts", ["value"], 60).collect() == []
