"""Landing-zone tables of feeds to the bar schema: renames, units, previous closes and factors. All Columns, no row loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import series as S
from barloom.functions.clean import ratio

COLUMNS = ("open", "high", "low", "close", "pre_close", "volume", "amount", "turnover_rate", "adj_factor", "settle", "open_interest")


def LINE():
    return S.line("symbol")


def finish(df: DataFrame) -> DataFrame:
    """The declared columns, absent ones NULL, not suspended."""
    return df.select("symbol", "date", *[(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c) for c in COLUMNS], F.lit(False).alias("suspended"))


def _filled(x: Column) -> Column:
    """Forward, then backward."""
    back = Window.partitionBy("symbol").orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(S.fill_forward(x, LINE()), F.first(x, ignorenulls=True).over(back))


def _with_hfq(raw: DataFrame, adjusted: DataFrame | None, default: float | None = None) -> DataFrame:
    """``__ratio`` (adjusted close over close, where close > 0) and ``adj_factor`` (the same, filled)."""
    if adjusted is None:
        return raw.withColumns({"__ratio": F.lit(None).cast("double"), "adj_factor": F.lit(default).cast("double")})
    other = adjusted.select("symbol", "date", F.col("close").cast("double").alias("__adj"))
    joined = raw.join(other, ["symbol", "date"], "left").withColumn("__ratio", F.when(F.col("close") > 0, ratio(F.col("__adj"), F.col("close"))))
    return joined.withColumn("adj_factor", _filled(F.col("__ratio")))


def with_change(raw: DataFrame, adjusted: DataFrame | None = None, default: float | None = None) -> DataFrame:
    """Feeds that state the day's change: previous close = close - change."""
    df = _with_hfq(raw, adjusted, default)
    before = F.col("close") - F.col("change") if "change" in raw.columns else S.ref(F.col("close"), 1, LINE())
    return finish(df.withColumn("pre_close", before))


def in_shares(raw: DataFrame, adjusted: DataFrame | None = None) -> DataFrame:
    """Feeds in shares and fractions: volume / 100, turnover x 100; previous close = last close times the step of the factor."""
    df = raw.withColumn("volume", F.col("volume") / 100)
    if "turnover" in df.columns:
        df = df.withColumn("turnover_rate", F.col("turnover") * 100)
    df = _with_hfq(df, adjusted)
    step = ratio(F.col("__ratio"), S.ref(F.col("__ratio"), 1, LINE())) if adjusted is not None else F.lit(1.0)
    return finish(df.withColumn("pre_close", S.ref(F.col("close"), 1, LINE()) * step))


def fund(raw: DataFrame) -> DataFrame:
    return finish(raw.withColumns({"volume": F.col("volume") / 100, "pre_close": S.ref(F.col("close"), 1, LINE())}))


def index(raw: DataFrame) -> DataFrame:
    return finish(raw.withColumns({"pre_close": S.ref(F.col("close"), 1, LINE()), "adj_factor": F.lit(1.0)}))


def minutes(raw: DataFrame, *, shares: bool = False, futures: bool = False) -> DataFrame:
    """Minute bars: previous close is that of the bar before; of futures, held contracts are the open interest and the factor is 1."""
    df = raw.withColumn("pre_close", S.ref(F.col("close"), 1, LINE()))
    if shares:
        df = df.withColumn("volume", F.col("volume") / 100)
    if futures:
        df = df.withColumns({"open_interest": F.col("hold"), "adj_factor": F.lit(1.0)})
    return finish(df)


def compact(raw: DataFrame, factor: DataFrame | None = None, *, amount_scale: float = 1000.0, futures: bool = False, index_like: bool = False) -> DataFrame:
    """Feeds with trade_date yyyyMMdd, vol, oi and scaled amounts; factors come as a table of their own and are filled over gaps."""
    df = raw.withColumns({"date": F.to_date(F.col("trade_date").cast("string"), "yyyyMMdd"), "amount": F.col("amount") * amount_scale}).withColumnsRenamed({"vol": "volume", "oi": "open_interest"})
    if futures:
        df = df.withColumn("pre_close", S.ref(F.col("close"), 1, LINE()))
    if factor is not None:
        other = factor.select("symbol", F.to_date(F.col("trade_date").cast("string"), "yyyyMMdd").alias("date"), F.col("adj_factor").alias("__f"))
        df = df.drop("adj_factor").join(other, ["symbol", "date"], "left").withColumn("adj_factor", _filled(F.col("__f")))
    else:
        df = df.withColumn("adj_factor", F.lit(1.0 if futures or index_like else None).cast("double"))
    return finish(df)


def overseas(raw: DataFrame, end: str | None = None) -> DataFrame:
    """Feeds with zoned times and a column of adjusted closes; ``end`` is the last day wanted, whatever the feed's own end means."""
    df = raw.withColumn("date", F.col("date").cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    factor = F.when(F.col("close") > 0, ratio(F.col("adj_close"), F.col("close")))
    return finish(df.withColumns({"adj_factor": factor, "pre_close": S.ref(F.col("close"), 1, LINE())}))


def apply_events(bars: DataFrame, events: DataFrame, *, literal_consolidation: bool = False) -> DataFrame:
    """Corporate actions to ``adj_factor`` and ex-right ``pre_close``.

    ``events``: symbol, date, category, cash (per 10 shares), bonus, rights (per 10), rights_price, ratio. Category 1: reference price
    (prev - cash + rights x price) / (1 + bonus + rights), step prev / reference. Category 11: step as given, previous close prev / step
    (``literal_consolidation`` multiplies instead). Steps outside (0.02, 25), events off the bars, without a close before, or without effect are
    passed over. Several events of a day compound.
    """
    before = bars.withColumn("__prev", S.ref(F.col("close"), 1, LINE())).select("symbol", "date", "__prev")
    cash, bonus, rights, price = (F.coalesce(F.col(c), F.lit(0.0)) / d for c, d in (("cash", 10), ("bonus", 10), ("rights", 10), ("rights_price", 1)))
    met = events.join(before, ["symbol", "date"]).where("__prev > 0")
    reference = (F.col("__prev") - cash + rights * price) / (1 + bonus + rights)
    one = (F.col("category") == 1) & ~((cash == 0) & (bonus == 0) & (rights == 0)) & (reference > 0)
    step = F.when(one, ratio(F.col("__prev"), reference)).when(F.col("category") == 11, F.col("ratio"))
    kept = met.withColumn("__step", step).where("__step > 0.02 and __step < 25")
    daily = kept.groupBy("symbol", "date").agg(F.product("__step").alias("__step"), F.product(F.when(F.lit(literal_consolidation) & (F.col("category") == 11), 1 / F.col("__step")).otherwise(F.col("__step"))).alias("__down"))
    joined = bars.drop("adj_factor").join(daily, ["symbol", "date"], "left")
    return joined.withColumns({"pre_close": F.when(F.col("__down").isNotNull(), S.ref(F.col("close"), 1, LINE()) / F.col("__down")).otherwise(F.col("pre_close")), "adj_factor": S.step_product(F.col("__step"), LINE())}).select(*[c for c in bars.columns if c != "adj_factor"], "adj_factor")
