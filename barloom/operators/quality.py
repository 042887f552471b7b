"""Validation and health of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import series as S
from barloom.functions.clean import present

TOLERANCE = 1e-6


class InvalidBars(ValueError):
    """Bars break a rule; ``problems`` maps rules to row counts."""

    def __init__(self, problems: dict[str, int]):
        super().__init__(", ".join(f"{k}: {n}" for k, n in problems.items()))
        self.problems = problems


REQUIRED = ("symbol", "date", "open", "high", "low", "close")
OPTIONAL = ("pre_close", "volume", "amount", "turnover_rate", "adj_factor", "settle", "open_interest")


def ohlc_broken(tolerance: float = TOLERANCE) -> Column:
    """High under low, or open or close outside of them."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return F.coalesce((F.col("high") + tolerance < F.col("low")) | (top > F.col("high") + tolerance) | (bottom < F.col("low") - tolerance), F.lit(False))


def coerce_bars(df: DataFrame, freq: str = "1d") -> tuple[DataFrame, dict[str, Column]]:
    """Bars in the declared types and order, and the rules as aggregate expressions over the uncoerced frame.

    Days lose their time, minutes their seconds; numbers that can't be read and keys or prices without value break a rule; absent
    optional columns are NULL, absent or NULL ``suspended`` is FALSE; other columns are dropped.
    """
    if freq not in ("1d", "1m", "5m"):
        raise ValueError("freq is 1d, 1m or 5m")
    lost = [c for c in REQUIRED if c not in df.columns]
    if lost:
        raise InvalidBars({f"no column {c}": 1 for c in lost})

    def number(c: str) -> Column:
        if c not in df.columns:
            return F.lit(None).cast("double")
        return present(F.col(c).try_cast("double"))

    date = F.col("date").try_cast("timestamp_ntz")
    date = date.cast("date") if freq == "1d" else F.date_trunc("minute", date).cast("timestamp_ntz")
    flag = F.coalesce(F.col("suspended").try_cast("boolean"), F.lit(False)) if "suspended" in df.columns else F.lit(False)
    out = df.select(F.col("symbol").cast("string").alias("symbol"), date.alias("date"), *[number(c).alias(c) for c in (*REQUIRED[2:], *OPTIONAL)], flag.alias("suspended"))
    rules = {"unreadable date": F.count_if(F.col("date").isNotNull() & date.isNull()), "missing key": F.count_if(F.col("symbol").isNull() | F.col("date").isNull())}
    for c in (*REQUIRED[2:], *OPTIONAL):
        if c in df.columns and dict(df.dtypes)[c] == "string":
            rules[f"unreadable {c}"] = F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull())
    for c in REQUIRED[2:]:
        rules[f"missing {c}"] = F.count_if(number(c).isNull())
    o, h, low, c = (number(x) for x in REQUIRED[2:])
    rules["broken prices"] = F.count_if(F.coalesce((h + TOLERANCE < low) | (F.greatest(o, c) > h + TOLERANCE) | (F.least(o, c) < low - TOLERANCE), F.lit(False)))
    return out, rules


def validate_bars(df: DataFrame, freq: str = "1d") -> DataFrame:
    """Coerced bars, or InvalidBars; all rules are counted in one pass."""
    out, rules = coerce_bars(df, freq)
    counts = df.agg(*[x.alias(f"r{i}") for i, x in enumerate(rules.values())]).first()
    problems = {k: int(n) for k, n in zip(rules, counts) if n}
    if problems:
        raise InvalidBars(problems)
    return out.select("symbol", "date", *REQUIRED[2:], *OPTIONAL, "suspended")


def health(bars: DataFrame, calendar: DataFrame, jump: float = 0.2, samples: int = 3) -> DataFrame:
    """Per symbol: rows, first and last day, missing trading days, broken prices, missing closes, share of missing factors, longest idle run, big moves.

    A missing day is a trading day between first and last without a bar: trading days in the span less bars on trading days, so that
    no grid is built. Of the big moves the first ``samples`` are listed.
    """
    w = S.line("symbol")
    days = calendar.select(F.col("date").cast("date").alias("__day")).where("__day is not null").distinct()
    before = Window.orderBy("__day")
    cal = days.withColumn("__o", F.row_number().over(before))
    marked = bars.join(cal, F.col("date") == F.col("__day"), "left")
    ret = S.roc(F.col("close"), 1, w)
    rows = marked.select("symbol", "date", "close", "adj_factor", "__o", ohlc_broken().alias("__bad"), F.abs(ret).alias("__move"), F.coalesce(F.col("volume") <= 0, F.lit(False)).cast("int").alias("__idle"))
    rows = rows.withColumn("__new", S.run_id(F.col("__idle"), w)).withColumn("__run", F.sum("__new").over(w))
    streak = F.sum("__idle").over(Window.partitionBy("symbol", "__run").orderBy("date"))
    big = F.col("__move") > jump
    nth = F.when(big, F.count_if(big).over(w))
    rows = rows.select("*", streak.alias("__streak"), nth.alias("__nth"))
    found = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_if("__bad").alias("ohlc_violations"), F.count_if(F.col("close").isNull()).alias("null_closes"),
        F.avg(F.col("adj_factor").isNull().cast("double")).alias("factor_missing"), F.max("__streak").alias("idle_days"),
        F.array_sort(F.collect_list(F.when(F.col("__nth") <= samples, F.struct("date", "close")))).alias("__jumps"), F.count("__o").alias("__on"),
    )
    # trading days up to a day: the calendar's running count, carried to every day of its span
    upto = days.select("__day", F.count(F.lit(1)).over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("__c"), F.lead("__day").over(before).alias("__next"))
    upto = upto.select("__c", "__day", F.explode(F.sequence("__day", F.date_sub(F.coalesce("__next", F.date_add("__day", 1)), 1))).alias("__at"))
    a = upto.select(F.col("__at").alias("__a"), F.col("__c").alias("__ca"), (F.col("__at") == F.col("__day")).cast("int").alias("__own"))
    z = upto.select(F.col("__at").alias("__z"), F.col("__c").alias("__cz"))
    spanned = found.join(a, F.col("first") == F.col("__a"), "left").join(z, F.col("last") == F.col("__z"), "left")
    end = days.agg(F.max("__day").alias("day"), F.count(F.lit(1)).alias("n")).first()

    def counted(when: str, upto: Column) -> Column:
        """Trading days up to a day, all of them behind the calendar's end."""
        return F.when(F.col(when) > F.lit(end.day), F.lit(end.n)).otherwise(F.coalesce(upto, F.lit(0)))

    inside = counted("last", F.col("__cz")) - counted("first", F.col("__ca") - F.col("__own"))
    text = F.concat_ws(",", F.transform("__jumps", lambda j: F.date_format(j.date, "yyyy-MM-dd")))
    return spanned.select("symbol", "n_rows", "first", "last", (inside - F.col("__on")).alias("missing_calendar_days"), "ohlc_violations", "null_closes", "factor_missing", "idle_days", text.alias("big_jumps"))
