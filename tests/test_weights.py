import numpy as np

from barloom.ml import optimize
from barloom.plans.simulated import m07_weights


def test_factor_gives_the_weights_of_its_matrix():
    rng = np.random.default_rng(2)
    z, mu = rng.normal(0, 0.02, (40, 60)), rng.normal(0, 0.001, 60)
    s, dense = optimize.Factored(z, 1e-6), z.T @ z + 1e-6 * np.eye(60)
    assert np.allclose(optimize.min_variance(s), optimize.min_variance(dense), atol=1e-5)
    assert np.allclose(optimize.mean_variance(mu, s), optimize.mean_variance(mu, dense), atol=1e-5)
    w = s.risk_parity()
    parts = w * (dense @ w)
    assert np.allclose(parts, parts.mean(), rtol=1e-5) and abs(w.sum() - 1) < 1e-9


def test_weights_of_every_symbol_and_date(spark, tmp_path):
    rng, start = np.random.default_rng(4), np.datetime64("2021-01-04")
    data = []
    for k in range(15):
        for i in range(3 if k == 14 else 30):
            data.append((f"{k:06d}.SH", str(start + i), 10 * (1 + float(rng.normal(0, 0.01 * (k + 1)))), 10.0))
    b = spark.createDataFrame(data, "symbol string, date string, close double, pre_close double")
    b = b.selectExpr("symbol", "cast(date as timestamp_ntz) date", "close open", "close high", "close low", "close", "pre_close", "1d volume", "1d amount", "1d turnover_rate", "1d adj_factor", "false suspended", "0d settle", "0d open_interest", "cast(date as timestamp_ntz) updated_at")
    b.write.parquet(str(tmp_path / "daily_bars.parquet"))
    found = {r.symbol: r for r in m07_weights(spark, str(tmp_path)).collect()}
    assert len(found) == 15 and found["000014.SH"].risk_parity is None
    for c in ("min_variance", "mean_variance", "risk_parity"):
        assert abs(sum(r[c] for s, r in found.items() if s != "000014.SH") - 1) < 1e-4
    assert all(r.risk_parity > 0 for s, r in found.items() if s != "000014.SH")


def factor(columns: int, days: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Columns that start and end at any row, and their matrix."""
    rng = np.random.default_rng(9)
    rows, values, z = [], [], np.zeros((days, columns))
    for k in range(columns):
        start = int(rng.integers(0, days - 5))
        rows.append(rng.permutation(np.arange(start, int(rng.integers(start + 3, days + 1)))))
        values.append(rng.normal(0, 0.02, len(rows[-1])))
        z[rows[-1], k] = values[-1]
    return rows, values, z


def test_weights_are_the_optimum_to_the_digits_shown(monkeypatch):
    """Of more symbols than days and with a ridge as small as that of m07: in the support all slopes are equal, elsewhere they are greater."""
    monkeypatch.setattr(optimize, "TOGETHER", 32, raising=False)
    for columns, days in ((300, 40), (30, 80), (1, 20)):
        rows, values, z = factor(columns, days)
        mu = np.random.default_rng(1).normal(0, 1e-5, columns)
        dense = z.T @ z + 1e-8 * np.eye(columns)
        for s in (optimize.Factored(z, 1e-8), optimize.Factored.of_columns(rows, values, days, 1e-8)):
            for linear, w in ((0 * mu, optimize.min_variance(s)), (mu, optimize.mean_variance(mu, s))):
                assert abs(w.sum() - 1) < 1e-12 and w.min() >= 0
                slope = 2 * dense @ w - linear
                # a weight moved between any two symbols until they agree is less than half of the sixth decimal
                assert (slope[w > 1e-6].max() - slope.min()) / 2e-8 < 5e-7
            w = s.risk_parity()
            assert np.allclose(w * (dense @ w), (w @ dense @ w) / columns, rtol=1e-6)
