"""Queries of indicators, windows and factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions import series as S
from barloom.operators import factors
from barloom.operators.ewm import recursive
from barloom.plans.base import D, W, bars, day, dense, lag, q6, r6, roll, sql

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return add


def C():
    return F.col("close")


def LINE():
    return S.line("symbol")


def out(df: DataFrame, **cols) -> DataFrame:
    return df.select("symbol", day().alias("date"), *[c.alias(n) for n, c in cols.items()])


def over_bars(name: str, spark_cols, sql_cols: dict) -> None:
    """A query of Columns over every symbol's own bars."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return out(bars(spark, sf), **spark_cols())

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = sql(f"SELECT symbol, {D}, " + ", ".join(f"{x} AS {n}" for n, x in sql_cols.items()) + " FROM b")


over_bars("i01_sma", lambda: {"sma5": r6(S.sma(C(), 5, LINE())), "sma20": r6(S.sma(C(), 20, LINE()))}, {"sma5": q6(roll("avg", 5, "close")), "sma20": q6(roll("avg", 20, "close"))})
over_bars("i02_ref", lambda: {"ref3": S.ref(C(), 3, LINE())}, {"ref3": lag("close", 3)})
over_bars("i04_diff", lambda: {"diff2": r6(S.diff(C(), 2, LINE()))}, {"diff2": q6(f"close - {lag('close', 2)}")})
over_bars("i05_hhv_llv", lambda: {"hhv10": S.hhv(F.col("high"), 10, LINE()), "llv10": S.llv(F.col("low"), 10, LINE())}, {"hhv10": roll("max", 10, "high"), "llv10": roll("min", 10, "low")})
over_bars("i08_roc", lambda: {"roc10": r6(S.roc(C(), 10, LINE()))}, {"roc10": q6(f"close / nullif({lag('close', 10)}, 0) - 1")})
over_bars("i09_bias", lambda: {"bias6": r6(S.bias(C(), 6, LINE()))}, {"bias6": q6(f"close / nullif({roll('avg', 6, 'close')}, 0) - 1")})
over_bars(
    "i12_boll",
    lambda: dict(zip(("mid", "up", "low"), map(r6, S.boll(C(), 20, 2.0, LINE())))),
    {"mid": q6(roll("avg", 20, "close")), "up": q6(f"{roll('avg', 20, 'close')} + 2 * {roll('stddev_samp', 20, 'close')}"), "low": q6(f"{roll('avg', 20, 'close')} - 2 * {roll('stddev_samp', 20, 'close')}")},
)
over_bars("w01_change", lambda: {"pct": r6(S.roc(C(), 1, LINE()))}, {"pct": q6(f"close / nullif({lag('close')}, 0) - 1")})
over_bars("w02_forward", lambda: {"fwd5": r6(F.try_divide(F.lead("close", 5).over(LINE()), C()) - 1)}, {"fwd5": q6(f"lead(close, 5) OVER ({W}) / nullif(close, 0) - 1")})
over_bars("w05_fill_forward", lambda: {"factor": S.fill_forward(F.col("adj_factor"), LINE()), "turnover": S.fill_forward(F.col("turnover_rate"), LINE())}, {"factor": f"last_value(adj_factor IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)", "turnover": f"last_value(turnover_rate IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)"})
over_bars("w13_zscore", lambda: {"z20": r6(S.zscore(F.col("volume"), 20, LINE())), "z60": r6(S.zscore(F.col("volume"), 60, LINE()))}, {f"z{n}": q6(f"(volume - {roll('avg', n, 'volume')}) / nullif({roll('stddev_samp', n, 'volume')}, 0)") for n in (20, 60)})


def crossing(down: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = bars(spark, sf).select("symbol", "date", S.sma(C(), 5, LINE()).alias("a"), S.sma(C(), 20, LINE()).alias("b"))
        f = S.cross_down if down else S.cross
        return out(df, crossed=f(F.round("a", 8), F.round("b", 8), LINE()))

    return run


for _name, _sign in (("i06_cross", (">", "<=")), ("i07_cross_down", ("<", ">="))):
    QUERIES[_name] = crossing(_sign[0] == "<")
    SQL[_name] = sql(f"SELECT symbol, {D}, coalesce(a {_sign[0]} b AND {lag('a')} {_sign[1]} {lag('b')}, false) AS crossed FROM m", f"m AS (SELECT symbol, d, round({roll('avg', 5, 'close')}, 8) AS a, round({roll('avg', 20, 'close')}, 8) AS b FROM b)")


@query("i13_atr", sql(f"SELECT symbol, {D}, {q6(roll('avg', 14, 'tr'))} AS atr14 FROM t", f"t AS (SELECT symbol, d, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM b)"))
def i13_atr(spark: SparkSession, sf: str) -> DataFrame:
    df = bars(spark, sf).withColumn("tr", S.true_range(F.col("high"), F.col("low"), C(), LINE()))
    return out(df, atr14=r6(S.sma(F.col("tr"), 14, LINE())))


#: y = alpha x + (1 - alpha) y' as recursion over the rows of a symbol.
NUMBERED = "n AS (SELECT symbol, d, open, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM b)"


def recursion(first: str, steps: dict[str, str], start: dict[str, str], final: dict[str, str], more: tuple[str, ...] = (), source: str = "n") -> str:
    names = ", ".join(steps)
    text = sql(
        f"SELECT symbol, {D}, " + ", ".join(f"{x} AS {n}" for n, x in final.items()) + " FROM y",
        NUMBERED, *more,
        f"y(symbol, d, i, {names}) AS (SELECT symbol, d, i, {', '.join(start.values())} FROM {source} n WHERE {first} UNION ALL SELECT n.symbol, n.d, n.i, {', '.join(steps.values())} FROM y JOIN {source} n ON n.symbol = y.symbol AND n.i = y.i + 1)",
    )
    return text.replace("WITH b AS", "WITH RECURSIVE b AS", 1)


@query("i03_ema", recursion("i = 1", {"e": "2.0 / 13 * n.close + (1 - 2.0 / 13) * y.e"}, {"e": "close"}, {"ema12": q6("e")}))
def i03_ema(spark: SparkSession, sf: str) -> DataFrame:
    return out(recursive(bars(spark, sf), {"ema12": ("ema", 12)}), ema12=r6("ema12"))


_f, _s = "(2.0 / 13 * n.close + (1 - 2.0 / 13) * y.f)", "(2.0 / 27 * n.close + (1 - 2.0 / 27) * y.s)"


@query("i10_macd", recursion("i = 1", {"f": _f, "s": _s, "a": f"0.2 * ({_f} - {_s}) + 0.8 * y.a"}, {"f": "close", "s": "close", "a": "0.0::DOUBLE"}, {"dif": q6("f - s"), "dea": q6("a"), "hist": q6("2 * (f - s - a)")}))
def i10_macd(spark: SparkSession, sf: str) -> DataFrame:
    return out(recursive(bars(spark, sf), {"m": ("macd", 12, 26, 9)}), dif=r6("m_dif"), dea=r6("m_dea"), hist=r6("m_hist"))


_u, _a = "(greatest(n.close - y.c, 0) / 14 + (1 - 1.0 / 14) * y.u)", "(abs(n.close - y.c) / 14 + (1 - 1.0 / 14) * y.a)"


@query("i11_rsi", recursion(
    "i = 1",
    {"c": "n.close", "u": f"CASE WHEN y.u IS NULL THEN greatest(n.close - y.c, 0) ELSE {_u} END", "a": f"CASE WHEN y.a IS NULL THEN abs(n.close - y.c) ELSE {_a} END"},
    {"c": "close", "u": "NULL::DOUBLE", "a": "NULL::DOUBLE"},
    {"rsi14": q6("CASE WHEN a <= 1e-12 AND u <= 1e-12 THEN 50 WHEN a <= 1e-12 THEN 100 ELSE u / a * 100 END")}))
def i11_rsi(spark: SparkSession, sf: str) -> DataFrame:
    return out(recursive(bars(spark, sf), {"rsi14": ("rsi", 14)}), rsi14=r6("rsi14"))


#: A gap of g rows without a place lets the old weight decay g times.
_K = "CASE WHEN n.v IS NULL THEN y.k WHEN y.k IS NULL THEN n.v ELSE (pow(2.0 / 3, y.g + 1) * y.k + n.v / 3) / (pow(2.0 / 3, y.g + 1) + 1.0 / 3) END"
_DD = f"CASE WHEN ({_K}) IS NULL THEN NULL WHEN y.e IS NULL THEN ({_K}) ELSE 2.0 / 3 * y.e + ({_K}) / 3 END"


@query("i14_kdj", recursion(
    "i = 1",
    {"k": _K, "e": _DD, "g": "CASE WHEN n.v IS NULL THEN y.g + 1 ELSE 0 END"},
    {"k": "v", "e": "v", "g": "0"},
    {"k": q6("k"), "d_": q6("e"), "j": q6("3 * k - 2 * e")},
    more=(f"r AS (SELECT symbol, d, i, (close - {roll('min', 9, 'low')}) / nullif({roll('max', 9, 'high')} - {roll('min', 9, 'low')}, 0) * 100 AS v0, {roll('max', 9, 'high')} > {roll('min', 9, 'low')} AS ok FROM n)", "rv AS (SELECT symbol, d, i, CASE WHEN ok THEN v0 END AS v FROM r)"), source="rv"))
def i14_kdj(spark: SparkSession, sf: str) -> DataFrame:
    return out(recursive(bars(spark, sf), {"x": ("kdj", 9, 3)}), k=r6("x_k"), d_=r6("x_d"), j=r6("x_j"))


@query("i15_sma_weighted", recursion("i = 1", {"e": "0.25 * n.close + 0.75 * y.e"}, {"e": "close"}, {"sma8_2": q6("e")}))
def i15_sma_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """SMA(X, N, M) with weight M / N for the newest value."""
    return out(recursive(bars(spark, sf), {"s": ("ewm", 2 / 8)}), sma8_2=r6("s"))


@query("w03_drawdown", sql(f"SELECT symbol, {D}, {q6(f'h / nullif(max(h) OVER ({W} ROWS UNBOUNDED PRECEDING), 0) - 1')} AS dd FROM (SELECT symbol, d, close * coalesce(adj_factor, 1) AS h FROM b)"))
def w03_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.operators.panel import hfq

    return out(bars(spark, sf).withColumn("h", hfq()), dd=r6(S.drawdown(F.col("h"), LINE())))


@query("w04_growth", sql(f"SELECT symbol, {D}, round(product(1 + coalesce(r, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS nav FROM m", f"m AS (SELECT symbol, d, CASE WHEN close > 0 AND pre_close > 0 THEN greatest(least(close / pre_close - 1, 0.3), -0.3) END AS r FROM b)"))
def w04_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Growth of daily moves held to 30 %."""
    move = F.when((C() > 0) & (F.col("pre_close") > 0), F.greatest(F.least(C() / F.col("pre_close") - 1, F.lit(0.3)), F.lit(-0.3)))
    return out(bars(spark, sf).withColumn("r", move), nav=F.round(S.growth(F.col("r"), LINE()), 4) + F.lit(0.0))


@query("w06_event_factor", sql(f"SELECT symbol, {D}, {q6(f'product(coalesce(ratio, 1)) OVER ({W} ROWS UNBOUNDED PRECEDING)')} AS factor FROM m", f"m AS (SELECT symbol, d, CASE WHEN pre_close > 0 AND {lag('close')} > 0 AND abs({lag('close')} / nullif(pre_close, 0) - 1) > 0.02 AND {lag('close')} / nullif(pre_close, 0) > 0.02 AND {lag('close')} / nullif(pre_close, 0) < 25 THEN {lag('close')} / pre_close END AS ratio FROM b)"))
def w06_event_factor(spark: SparkSession, sf: str) -> DataFrame:
    """Factor as running product of the steps between a close and the next day's stated previous close."""
    before = F.lag("close").over(LINE())
    step = F.try_divide(before, F.col("pre_close"))
    ratio = F.when((F.col("pre_close") > 0) & (before > 0) & (F.abs(step - 1) > 0.02) & (step > 0.02) & (step < 25), step)
    return out(bars(spark, sf).withColumn("ratio", ratio), factor=r6(S.step_product(F.col("ratio"), LINE())))


@query("w07_roll_factor", sql(f"SELECT symbol, {D}, round(product(f) OVER ({W} ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS factor FROM m", f"m AS (SELECT symbol, d, CASE WHEN close > 0 AND {lag('close')} > 0 AND abs(close / {lag('close')} - 1) > 0.15 THEN {lag('close')} / close ELSE 1 END AS f FROM b)"))
def w07_roll_factor(spark: SparkSession, sf: str) -> DataFrame:
    return out(bars(spark, sf).withColumn("c", F.when(C() > 0, C())), factor=F.round(S.roll_factor(F.col("c"), 0.15, LINE()), 4) + F.lit(0.0))


@query("w08_idle_streak", sql(f"""SELECT symbol, coalesce(max(n), 0) AS idle_days FROM (SELECT symbol, run, sum(z) AS n FROM m2 GROUP BY ALL) GROUP BY symbol""", f"m AS (SELECT symbol, d, (coalesce(volume, 1) <= 0)::INT AS z FROM b)", f"m1 AS (SELECT *, CASE WHEN z = {lag('z')} THEN 0 ELSE 1 END AS new FROM m)", f"m2 AS (SELECT *, sum(new) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM m1)"))
def w08_idle_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Longest run of bars without volume; a missing volume is no idle bar."""
    df = bars(spark, sf).withColumn("z", F.coalesce(F.col("volume") <= 0, F.lit(False)).cast("int"))
    df = df.withColumn("new", S.run_id(F.col("z"), LINE())).withColumn("run", F.sum("new").over(LINE()))
    return df.groupBy("symbol", "run").agg(F.sum("z").alias("n")).groupBy("symbol").agg(F.max("n").alias("idle_days"))


@query("w12_rolling_sharpe", sql(f"SELECT symbol, {D}, {q6(f'''({roll('avg', 60, 'r')}) / nullif({roll('stddev_samp', 60, 'r')}, 0) * sqrt(252)''')} AS sharpe60 FROM m", f"m AS (SELECT symbol, d, close / nullif({lag('close')}, 0) - 1 AS r FROM b)"))
def w12_rolling_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    df = bars(spark, sf).withColumn("r", S.roc(C(), 1, LINE()))
    return out(df, sharpe60=r6(F.try_divide(S.sma(F.col("r"), 60, LINE()), S.deviation(F.col("r"), 60, LINE())) * F.sqrt(F.lit(252.0))))


def factor_query(name: str, factor: str, text: str, more: tuple[str, ...] = (), source: str = "p", **params) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        panel = dense(spark, sf, ["open", "high", "low", "close", "volume", "amount", "turnover_rate", "adj_factor"])
        return out(factors.compute(panel, [("value", factor, params)]), value=r6("value")).where("value is not null")

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = sql(f"SELECT * FROM (SELECT symbol, {D}, {q6(text)} AS value FROM {source}) WHERE value IS NOT NULL", *more, panel=True)


def _mom(n: int) -> str:
    return f"h / nullif({lag('h', n)}, 0) - 1"


ILLIQ = ("q AS (SELECT *, abs(ret) / nullif(amount, 0) * 1e9 AS il, high / nullif(low, 0) - 1 AS amp FROM p)",)
TR = (f"q AS (SELECT *, greatest((high - low) * coalesce(adj_factor, 1), abs(high * coalesce(adj_factor, 1) - {lag('h')}), abs(low * coalesce(adj_factor, 1) - {lag('h')})) AS tr FROM p)",)
factor_query("f01_mom", "Mom", _mom(20))
factor_query("f02_reversal", "Reversal", f"-({_mom(5)})")
factor_query("f03_volatility", "Volatility", roll("stddev_samp", 20, "ret"))
factor_query("f04_illiq", "Illiq", roll("avg", 20, "il"), ILLIQ, "q")
factor_query("f05_vwap_deviation", "VWAPDev", "close / nullif(CASE WHEN volume > 0 THEN amount / (volume * 100) END, 0) - 1")
factor_query("f06_atr_ratio", "AtrRatio", f"{roll('avg', 14, 'tr')} / nullif(h, 0)", TR, "q")
factor_query("f07_mom60", "Mom", _mom(60), n=60)
factor_query("f07_mom120", "Mom", _mom(120), n=120)
factor_query("f07_rev20", "Reversal", f"-({_mom(20)})", n=20)
factor_query("f07_vol20", "LowVolatility", f"-({roll('stddev_samp', 20, 'ret')})")
factor_query("f07_amp20", "Amplitude", f"-({roll('avg', 20, 'amp')})", ILLIQ, "q")
factor_query("f07_turnover20", "Turnover", f"-({roll('avg', 20, 'turnover_rate')})")


@query("f10_factor_set", sql(f"SELECT * FROM (SELECT symbol, {D}, {q6(_mom(20))} AS mom20, {q6(f'-({_mom(5)})')} AS rev5, {q6('-(' + roll('stddev_samp', 20, 'ret') + ')')} AS vol20 FROM p) WHERE mom20 IS NOT NULL OR rev5 IS NOT NULL OR vol20 IS NOT NULL", panel=True))
def f10_factor_set(spark: SparkSession, sf: str) -> DataFrame:
    """Several registered factors in one pass over one window."""
    panel = dense(spark, sf, ["open", "high", "low", "close", "volume", "amount", "turnover_rate", "adj_factor"])
    df = factors.compute(panel, [("mom20", "Mom", {}), ("rev5", "Reversal", {}), ("vol20", "LowVolatility", {})])
    return out(df, mom20=r6("mom20"), rev5=r6("rev5"), vol20=r6("vol20")).where("mom20 is not null or rev5 is not null or vol20 is not null")



