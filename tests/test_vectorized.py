import datetime as dt
import random

import pytest

from barloom.operators import panel as P, vectorized as V


def test_portfolio_on_bars_alone_equals_that_of_the_dense_panel(spark):
    rng = random.Random(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    data = [(s, d, 10 + rng.random(), rng.choice([None, 0.5, -0.5, 0.25])) for s in "abcde" for d in days if rng.random() < 0.6]
    bars = spark.createDataFrame(data, "symbol string, date date, h double, weight double")
    rows, dates = P.on_dates(bars)
    for lag in (1, 3):
        # on gaps a price stands still, and a weight that is not given again is given up
        dense = P.densify(bars, ["h", "weight"])
        want = {r.date: tuple(r)[1:] for r in V.portfolio(dense, lag=lag).collect()}
        got = {r.date: tuple(r)[1:] for r in V.portfolio_on_rows(rows, dates, lag=lag).collect()}
        assert set(got) == set(want)
        for d in want:
            assert got[d] == pytest.approx(want[d], abs=1e-12)
    with pytest.raises(ValueError):
        V.portfolio_on_rows(rows, dates, lag=0)


def test_no_bars(spark):
    rows, dates = P.on_dates(spark.createDataFrame([], "symbol string, date date, h double, weight double"))
    assert V.portfolio_on_rows(rows, dates).collect() == []
