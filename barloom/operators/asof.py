"""Attributes as known at event time: validity intervals, time buckets, one equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, Window

from barloom.functions.clean import quoted

#: Days in a time bucket: an interval is copied once per bucket it touches, an event falls into one.
BUCKET_DAYS = 64


def holding_intervals(changes: DataFrame, entity: str, known: str, rank: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Half-open intervals [``__from``, ``__to``) in which an attribute row holds; ``__to`` is null for the last one.

    At any day the row with the greatest ``rank`` (compared in order) among those known by then holds. Rows are first reduced to the best
    one per entity and day of knowledge, so that the window sees days, not rows. Rows without entity or day are ignored.
    """
    best = F.struct(*[quoted(r).alias(f"r{i}") for i, r in enumerate(rank)], *[quoted(a).alias(f"a{i}") for i, a in enumerate(attributes)])
    daily = changes.select(quoted(entity).alias("__entity"), quoted(known).cast("date").alias("__known"), best.alias("__best")).where("__entity is not null and __known is not null")
    daily = daily.groupBy("__entity", "__known").agg(F.max("__best").alias("__best"))
    line = Window.partitionBy("__entity").orderBy("__known")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = daily.select("__entity", F.col("__known").alias("__from"), F.max("__best").over(upto).alias("__held"), F.max("__best").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    held = held.where("__before is null or __held > __before")
    return held.select("__entity", "__from", F.lead("__from").over(Window.partitionBy("__entity").orderBy("__from")).alias("__to"), "__held")


def known_at(events: DataFrame, changes: DataFrame, *, event_entity: str, event_time: str, entity: str, known: str, rank: Sequence[str], attributes: Sequence[str], how: str = "left", bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """Events with the attributes that held, as far as known, on the day of the event.

    All columns of ``events`` stay; attributes are added under their names (with ``_known`` behind, where an event column has that name).
    ``how`` is ``left`` (events without a row get nulls) or ``inner``. A row known on day d serves events of day d and later, until a
    better-ranked one is known. Intervals are copied into the buckets of ``bucket_days`` they touch, from the bucket they begin in to the last
    one an event of their entity falls into, and events meet them on (entity, bucket): a hot entity is spread over its buckets. Events with a null entity
    or time match nothing. Repeated changes have no effect.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is 'left' or 'inner'")
    epoch = F.lit("1970-01-01").cast("date")

    def bucket(d):
        return F.floor(F.datediff(d, epoch) / F.lit(bucket_days)).cast("int")

    mine = events.select("*", quoted(event_entity).alias("__who"), quoted(event_time).cast("date").alias("__when")).withColumn("__slot", bucket(F.col("__when")))
    ends = mine.where("__who is not null and __slot is not null").groupBy(F.col("__who").alias("__e")).agg(F.max("__slot").alias("__horizon"))
    intervals = holding_intervals(changes, entity, known, rank, attributes).join(ends, F.col("__entity") == F.col("__e"))
    first, last = bucket(F.col("__from")), F.least(F.coalesce(bucket(F.date_sub("__to", 1)), F.col("__horizon")), F.col("__horizon"))
    spread = intervals.where(first <= F.col("__horizon")).select("*", F.explode(F.sequence(first, F.greatest(first, last))).alias("__bucket"))
    taken = set(events.columns)
    names = [a if a not in taken else f"{a}_known" for a in attributes]
    spread = spread.select("__entity", "__bucket", "__from", "__to", *[F.col(f"__held.a{i}").alias(f"__a{i}") for i in range(len(attributes))])
    on = (F.col("__who") == F.col("__entity")) & (F.col("__slot") == F.col("__bucket")) & (F.col("__when") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("__when") < F.col("__to")))
    met = mine.join(spread, on, how)
    return met.select(*[quoted(c) for c in events.columns], *[F.col(f"__a{i}").alias(n) for i, n in enumerate(names)])
