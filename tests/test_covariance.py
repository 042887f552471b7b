import itertools

import numpy as np

from barloom.operators import covariance
from barloom.plans.research import a20_covariance


def series(seed: int, n: int = 23) -> dict[str, dict[int, float]]:
    rng = np.random.default_rng(seed)
    out = {}
    for k in range(n):
        start, span = int(rng.integers(0, 40)), int(rng.integers(3, 70))
        days = [d for d in range(start, start + span) if rng.random() < 0.9]
        out[f"{(k * 7919) % 100:02d}é{'X' * (k % 3)}"] = {d: float(rng.normal(0, 0.02)) if k % 5 else 0.01 for d in days}
    return out


def brute(data: dict[str, dict[int, float]], least: int) -> dict:
    out = {}
    for a, b in itertools.combinations_with_replacement(sorted(data), 2):
        common = sorted(data[a].keys() & data[b].keys())
        if len(common) >= least:
            out[a, b] = (round(float(np.cov([data[a][d] for d in common], [data[b][d] for d in common])[0, 1]), 8) + 0.0, len(common))
    return out


def test_blocks_and_stripes_give_every_pair_once(spark, monkeypatch):
    data = series(3)
    df = spark.createDataFrame([(s, d, r) for s, x in data.items() for d, r in x.items()] + [(None, 1, 1.0), ("00é", None, 1.0), ("00é", 999, None)], "symbol string, d int, r double").selectExpr("symbol", "date_add(date'2020-01-01', d) as date", "r")
    expected = brute(data, 20)
    assert len(expected) > 60
    for block, stripes, most in ((512, 10, 8192), (4, 3, 100), (5, 2, 3)):
        for name, value in (("BLOCK", block), ("STRIPES", stripes), ("MOST_IN_STRIPE", most)):
            monkeypatch.setattr(covariance, name, value)
        found = covariance.pairwise_covariance(df, 20).collect()
        assert len(found) == len(expected)
        for r in found:
            cov, n = expected[r.sym_a, r.sym_b]
            assert r.n == n and abs(r["cov"] - cov) < 1.5e-8
    assert covariance.pairwise_covariance(df.limit(0), 20).collect() == []


def test_no_row_per_pair_of_bars(spark, tmp_path):
    """What moves grows with the bars: no join of bars with bars, whose rows go by the square of the symbols of a day."""
    days = spark.range(25).selectExpr("explode(array('a', 'b', 'c')) symbol", "cast(date_add(date'2021-01-04', cast(id as int)) as timestamp_ntz) date", "id")
    b = days.selectExpr("symbol", "date", "10d open", "10d high", "10d low", "case symbol when 'a' then 10 + id % 3 when 'b' then 10 - id % 3 else double('nan') end close", "10d pre_close", "1d volume", "1d amount", "1d turnover_rate", "1d adj_factor", "false suspended", "0d settle", "0d open_interest", "date updated_at")
    b.write.parquet(str(tmp_path / "daily_bars.parquet"))
    df = a20_covariance(spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().toString()
    x = np.array([(k % 3) / 10 for k in range(25)])
    v = round(float(np.var(x, ddof=1)), 8)
    assert sorted((r.sym_a, r.sym_b, round(r["cov"], 7), r.n) for r in df.collect()) == [("a", "a", round(v, 7), 25), ("a", "b", round(-v, 7), 25), ("b", "b", round(v, 7), 25)]
