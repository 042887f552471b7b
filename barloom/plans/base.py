"""Views the reference queries share, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.operators import panel as P

#: Decimals at which results are compared: sums of doubles differ in the last places between engines.
RATES, MONEY = 6, 2


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return P.clean_bars(table(spark, sf, "daily_bars"))


def moves(spark: SparkSession, sf: str) -> DataFrame:
    """Daily moves held to 30 %, of all bars; none where a price is missing or not positive. Other fields are not carried along."""
    r = F.greatest(F.least(F.col("close") / F.col("pre_close") - 1, F.lit(0.3)), F.lit(-0.3))
    b = P.clean_bars(table(spark, sf, "daily_bars"), ("close", "pre_close"))
    return b.select("symbol", "date", F.when((F.col("close") > 0) & (F.col("pre_close") > 0), r).alias("r"))


def dense(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    return P.densify(bars(spark, sf), columns)


def r6(c: Column | str) -> Column:
    # adding zero makes -0.0 and 0.0 one value
    return F.round(F.col(c) if isinstance(c, str) else c, RATES) + F.lit(0.0)


def r2(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, MONEY) + F.lit(0.0)


def day(c: Column | str = "date") -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def v(c: str) -> str:
    return f"CASE WHEN {c}::VARCHAR <> 'nan' THEN {c} END AS {c}"


#: Clean bars: symbol, d (date), fields with NULL for NaN.
B = f"""b AS (SELECT symbol, d, open, high, low, close, {v('pre_close')}, {v('volume')}, {v('amount')}, {v('turnover_rate')}, {v('adj_factor')}, coalesce(suspended, false) AS suspended, updated_at
    FROM (SELECT *, date::DATE AS d, row_number() OVER (PARTITION BY symbol, date::DATE ORDER BY updated_at DESC) AS rn FROM daily_bars) WHERE rn = 1)"""
#: Dense panel with h (adjusted close) and ret (change over gaps).
P_ = """p0 AS (SELECT s.symbol, t.d, b.open, b.high, b.low, b.close, b.pre_close, b.volume, b.amount, b.turnover_rate, b.adj_factor, b.close * coalesce(b.adj_factor, 1) AS h
    FROM (SELECT DISTINCT symbol FROM b) s CROSS JOIN (SELECT DISTINCT d FROM b) t LEFT JOIN b ON b.symbol = s.symbol AND b.d = t.d),
    p AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING) / nullif(last_value(h IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS ret FROM p0)"""
W = "PARTITION BY symbol ORDER BY d"


def sql(body: str, *more: str, panel: bool = False) -> str:
    return "WITH " + ",\n    ".join([B, *([P_] if panel else []), *more]) + "\n" + body


def roll(agg: str, n: int, x: str) -> str:
    """An aggregate over the last n rows of a symbol with all n values present."""
    over = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg}({x}) {over} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def rank_avg(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


def rank_pct(x: str, by: str) -> str:
    return f"({rank_avg(x, by)}) / count({x}) OVER (PARTITION BY {by})"


D = "strftime(d, '%Y-%m-%d') AS date"


def q6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def q2(x: str) -> str:
    return f"round({x}, 2) + 0.0"
