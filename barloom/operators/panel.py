"""Bars, dense panels, calendars, and point-in-time alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.clean import present, ratio

NUMBERS = ("open", "high", "low", "close", "pre_close", "volume", "amount", "turnover_rate", "adj_factor")
PRICES = ("open", "high", "low", "close", "pre_close")


def clean_bars(raw: DataFrame, numbers: Sequence[str] = NUMBERS) -> DataFrame:
    """One row per (symbol, date): the latest delivery; days without time, NaN as NULL, suspended never NULL."""
    row = F.struct(*[present(c).alias(c) for c in numbers], F.coalesce("suspended", F.lit(False)).alias("suspended"), "updated_at")
    best = raw.groupBy("symbol", F.col("date").cast("date").alias("date")).agg(F.max_by(row, "updated_at").alias("r"))
    return best.select("symbol", "date", "r.*")


def hfq(price: str | Column = "close") -> Column:
    """Backward-adjusted price: a missing factor counts as 1."""
    return (F.col(price) if isinstance(price, str) else price) * F.coalesce("adj_factor", F.lit(1.0))


def latest_factor(bars: DataFrame) -> DataFrame:
    """Last present factor of each symbol over its full history."""
    return bars.groupBy("symbol").agg(F.max_by("adj_factor", F.when(F.col("adj_factor").isNotNull(), F.col("date"))).alias("latest_factor"))


def adjust(bars: DataFrame, mode: str, history: DataFrame | None = None) -> DataFrame:
    """Prices raw, ``hfq`` (times factor) or ``qfq`` (times factor over the latest factor of ``history``, 0 and none counting as 1)."""
    if mode == "raw":
        return bars
    factor = F.coalesce("adj_factor", F.lit(1.0))
    if mode == "hfq":
        return bars.withColumns({p: F.col(p) * factor for p in PRICES if p in bars.columns})
    if mode != "qfq":
        raise ValueError("mode is raw, hfq or qfq")
    base = latest_factor(history if history is not None else bars).withColumnRenamed("symbol", "__s")
    joined = bars.join(base, F.col("symbol") == F.col("__s"), "left")
    scale = factor / F.coalesce(F.when(F.col("latest_factor") != 0, F.col("latest_factor")), F.lit(1.0))
    return joined.withColumns({p: F.col(p) * scale for p in PRICES if p in bars.columns}).drop("__s", "latest_factor")


def densify(bars: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every symbol on every date of the table; missing cells are NULL.

    The grid comes from an equi-join on the year, so that no side is multiplied out in one task.
    """
    dates = bars.select("date").distinct().select("date", F.year("date").alias("__y"))
    years = dates.groupBy("__y").agg(F.collect_list("date").alias("__days"))
    span = bars.agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("z")).first()
    if span.a is None:
        return bars.select("symbol", "date", *columns)
    symbols = bars.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(span.a), F.lit(span.z))).alias("__y"))
    grid = symbols.join(years, "__y").select("symbol", F.explode("__days").alias("date"))
    empty = bars.schema
    marked = grid.select("symbol", "date", *[F.lit(None).cast(empty[c].dataType).alias(c) for c in columns])
    # partitioned by symbol alone, the aggregation and all windows over a symbol that follow need no further shuffle
    return marked.unionByName(bars.select("symbol", "date", *columns)).repartition("symbol").groupBy("symbol", "date").agg(*[F.max(c).alias(c) for c in columns])


def on_dates(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars with ``ord``, dates): the place of each bar's date among all dates of the table, and these dates with theirs.

    With places, a window by range looks back or ahead by dates of the table, as on a dense panel, over the bars alone.
    """
    dates = bars.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("ord"))  # a row per day
    return bars.join(dates, "date"), dates


def at(x: Column, n: int, by: str = "symbol") -> Column:
    """The value n dates away (before, if negative); NULL where there is no bar."""
    return F.max(x).over(Window.partitionBy(by).orderBy("ord").rangeBetween(n, n))


def trading_days(calendar: DataFrame) -> DataFrame:
    """Distinct days with their ordinal from 0. The calendar is one row per day, a few thousand in all."""
    days = calendar.select(F.col("date").cast("date").alias("date")).where("date is not null").distinct()
    return days.withColumn("ord", F.row_number().over(Window.orderBy("date")) - 1)


def shift_days(events: DataFrame, day: str, calendar: DataFrame, n: int) -> DataFrame:
    """``shifted``: the n-th trading day after (n > 0) or before (n < 0) ``day``, itself not counted; NULL beyond the calendar."""
    days = trading_days(calendar)
    end = days.agg(F.max("date").alias("date"), F.max("ord").alias("ord")).first()
    bounds = days.select(F.col("date").alias("__from"), "ord", F.lead("date").over(Window.orderBy("date")).alias("__to"))
    # each trading day opens an interval that holds the calendar days up to the next one
    filled = bounds.select("ord", "__from", F.explode(F.sequence("__from", F.date_sub(F.coalesce("__to", F.date_add("__from", 1)), 1))).alias("__day"))
    on = filled.select("__day", F.when((F.lit(n) < 0) & (F.col("__from") == F.col("__day")), F.col("ord") - 1).otherwise(F.col("ord")).alias("__at"))
    target = days.select(F.col("ord").alias("__o"), F.col("date").alias("shifted"))
    step = n if n > 0 else n + 1
    return events.join(on, F.col(day) == F.col("__day"), "left").withColumn("__at", F.when(F.col(day) > F.lit(end.date), F.lit(end.ord)).otherwise(F.col("__at")) + step).join(target, F.col("__at") == F.col("__o"), "left").drop("__day", "__at", "__o")


def membership(dates: DataFrame, snapshots: DataFrame, day: str = "date", taken: str = "taken", member: str = "member") -> DataFrame:
    """(day, member) by the latest snapshot not after the day; a day before all snapshots has no members."""
    tags = snapshots.select(F.col(taken).cast("date").alias("__t")).distinct()
    marks = dates.select(F.col(day).alias("__d"), F.lit(None).cast("date").alias("__t")).distinct().unionByName(tags.select(F.col("__t").alias("__d"), "__t"))
    # one row per day and per snapshot: small against the memberships
    order = Window.orderBy("__d", F.col("__t").isNull())
    at = marks.select("__d", "__t", F.last("__t", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("__use")).where("__t is null and __use is not null")
    members = snapshots.select(F.col(taken).cast("date").alias("__s"), F.col(member).alias(member)).distinct()
    return at.join(members, F.col("__use") == F.col("__s")).select(F.col("__d").alias(day), member)


def event_windows(events: DataFrame, bars: DataFrame, offsets: Sequence[tuple[str, int, int]], *, symbol: str = "symbol", announced: str = "announced", price: str = "close") -> DataFrame:
    """Events with one return per (name, a, b): price b rows after the first bar at or after the announcement, over that a rows after it.

    NULL where the window leaves the series, a price is missing, or the first one is not positive. Positions are found by carrying the
    next bar's place back over bars and events in one sorted pass per symbol.
    """
    own = Window.partitionBy("symbol").orderBy("date")
    series = bars.where(F.col(price).isNotNull()).select("symbol", "date", F.col(price).alias("__p"), (F.row_number().over(own) - 1).alias("__o"))
    marks = series.select("symbol", "date", "__o", F.lit(0).alias("__kind")).unionByName(events.select(F.col(symbol).alias("symbol"), F.col(announced).alias("date"), F.lit(None).cast("int").alias("__o"), F.lit(-1).alias("__kind")).distinct())
    ahead = Window.partitionBy("symbol").orderBy(F.col("date").desc(), F.col("__kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = marks.withColumn("__at", F.last("__o", ignorenulls=True).over(ahead)).where("__kind = -1 and __at is not null").select(F.col("symbol").alias("__s"), F.col("date").alias("__d"), "__at")
    found = events.join(at, (F.col(symbol) == F.col("__s")) & (F.col(announced) == F.col("__d"))).drop("__s", "__d")
    needed = sorted({o for _, a, b in offsets for o in (a, b)})
    around = found.select("*", F.explode(F.array(*[F.lit(o) for o in needed])).alias("__k")).select("*", (F.col("__at") + F.col("__k")).alias("__pos"))
    priced = around.join(series.select(F.col("symbol").alias("__s"), F.col("__o").alias("__pos2"), "__p"), (F.col(symbol) == F.col("__s")) & (F.col("__pos") == F.col("__pos2")), "left")
    by = priced.groupBy(*events.columns).agg(*[F.max(F.when(F.col("__k") == o, F.col("__p"))).alias(f"__p{i}") for i, o in enumerate(needed)])
    place = {o: F.col(f"__p{i}") for i, o in enumerate(needed)}
    return by.select(*events.columns, *[F.when(place[a] > 0, ratio(place[b], place[a]) - 1).alias(name) for name, a, b in offsets])
