"""Irregular readings onto a regular grid, shard by shard."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from barloom.functions.clean import quoted

#: Days in a time shard; a shard of a source never holds more grid points than this.
SHARD_DAYS = 91


def regularize(readings: DataFrame, grid: DataFrame | None, source: str, day: str, fields: Sequence[str], *, grid_day: str = "date", version: str | None = None, shard_days: int = SHARD_DAYS) -> DataFrame:
    """One row per source and grid day (every day, where ``grid`` is None) from the source's first reading to its last.

    Columns: ``source``, ``day`` (date), ``is_missing`` (no reading that day), ``<field>`` as read, ``<field>_filled`` (last present value at or
    before the day), ``days_since`` (days since the last reading, 0 on days with one).

    Each source is cut into time shards. Shards are summarised by their first and last reading and their last present values; a prefix scan
    over the summaries (one row per source and shard) gives every shard the state it starts from; then all shards, those without a reading
    too, are filled independently, so that a source with a third of all rows is spread over its shards.

    Of several readings of a source on a day, the one with the greatest ``version`` (then greatest values) holds. Readings off the grid give
    no row but carry their values on. NaN is missing. Readings without source or day are ignored. A repeated or null grid day counts once
    or not at all. Empty input gives no rows. Other columns are ignored.
    """
    fs = [f"__f{i}" for i in range(len(fields))]
    kinds = dict(readings.dtypes)
    clean = [(F.when(~F.isnan(quoted(f)), quoted(f)) if kinds[f] in ("double", "float") else quoted(f)).alias(n) for f, n in zip(fields, fs)]
    epoch = F.lit("1970-01-01").cast("date")

    def shard(d):
        return F.floor(F.datediff(d, epoch) / F.lit(shard_days)).cast("int")

    rows = readings.select(quoted(source).alias("__src"), quoted(day).cast("date").alias("__day"), *clean, (quoted(version) if version else F.lit(0)).alias("__ver")).where("__src is not null and __day is not null")
    daily = rows.groupBy("__src", "__day").agg(F.max(F.struct("__ver", *fs)).alias("__best")).select("__src", "__day", shard(F.col("__day")).alias("__shard"), *[F.col(f"__best.{n}").alias(n) for n in fs])

    # summaries: first and last reading, and the last present value of each field with its day
    summary = daily.groupBy("__src", "__shard").agg(F.min("__day").alias("__first"), F.max("__day").alias("__last"), *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("__day"))).alias(f"__end{n}") for n in fs])
    line = Window.partitionBy("__src").orderBy("__shard")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    scan = summary.select(
        "__src", "__shard",
        F.lead("__shard").over(line).alias("__next"),
        F.min("__first").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__from"),
        F.max("__last").over(past).alias("__carry_day"),
        F.col("__last"),
        *[F.last(F.col(f"__end{n}"), ignorenulls=True).over(past).alias(f"__carry{n}") for n in fs],
        *[F.last(F.col(f"__end{n}"), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"__out{n}") for n in fs],
    )
    # a shard with readings starts from the carried state; the empty ones up to the next start from what this one ends with
    own = F.struct(F.col("__shard").alias("s"), F.col("__carry_day").alias("d"), F.lit(True).alias("own"), *[F.col(f"__carry{n}").alias(n) for n in fs])
    gap = F.when(F.col("__next") > F.col("__shard") + 1, F.transform(F.sequence(F.col("__shard") + 1, F.col("__next") - 1), lambda s: F.struct(s.alias("s"), F.col("__last").alias("d"), F.lit(False).alias("own"), *[F.col(f"__out{n}").alias(n) for n in fs])))
    # the grid of a source ends with its last reading: only its last shard is cut
    shards = scan.select("__src", "__from", F.when(F.col("__next").isNull(), F.col("__last")).alias("__until"), F.explode(F.concat(F.array(own), F.coalesce(gap, F.array().cast(scan.select(F.array(own).alias("x")).schema["x"].dataType)))).alias("x"))
    shards = shards.select("__src", "__from", "__until", F.col("x.s").alias("__shard"), F.col("x.d").alias("__carry_day"), *[F.col(f"x.{n}").alias(f"__carry{n}") for n in fs])

    wanted = lambda d: (d >= F.col("__from")) & (F.col("__until").isNull() | (d <= F.col("__until")))
    carried = ["__carry_day", *[f"__carry{n}" for n in fs]]
    if grid is None:
        every = F.transform(F.sequence(F.lit(0), F.lit(shard_days - 1)), lambda k: F.date_add(epoch, F.col("__shard") * shard_days + k))
        points = shards.select("__src", "__shard", F.explode(F.filter(every, wanted)).alias("__day"), *carried)
    else:
        points = _grid_points(shards, grid, grid_day, shard, wanted, carried)

    points = points.select("__src", "__shard", "__day", F.lit(True).alias("__on"), F.lit(False).alias("__read"), "__carry_day", *[f"__carry{n}" for n in fs], *[F.lit(None).cast(kinds[f]).alias(n) for f, n in zip(fields, fs)])
    read = daily.select("__src", "__shard", "__day", F.lit(False).alias("__on"), F.lit(True).alias("__read"), F.lit(None).cast("date").alias("__carry_day"), *[F.lit(None).cast(kinds[f]).alias(f"__carry{n}") for f, n in zip(fields, fs)], *fs)
    merged = points.unionByName(read).repartition("__src", "__shard").groupBy("__src", "__shard", "__day").agg(F.max("__on").alias("__on"), F.max("__read").alias("__read"), F.max("__carry_day").alias("__carry_day"), *[F.max(f"__carry{n}").alias(f"__carry{n}") for n in fs], *[F.max(n).alias(n) for n in fs])
    inside = Window.partitionBy("__src", "__shard").orderBy("__day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_day = F.coalesce(F.last(F.when(F.col("__read"), F.col("__day")), ignorenulls=True).over(inside), F.col("__carry_day"))
    filled = [F.coalesce(F.last(n, ignorenulls=True).over(inside), F.col(f"__carry{n}")).alias(f"{f}_filled") for f, n in zip(fields, fs)]
    out = merged.select(F.col("__src").alias(source), F.col("__day").alias(day), (~F.col("__read")).alias("is_missing"), *[F.col(n).alias(f) for f, n in zip(fields, fs)], *filled, F.datediff("__day", last_day).alias("days_since"), "__on")
    return out.where("__on").drop("__on")


def _grid_points(shards: DataFrame, grid: DataFrame, grid_day: str, shard: Callable[[Column], Column], wanted: Callable[[Column], Column], carried: list[str]) -> DataFrame:
    """Days of the grid in each shard of each source, with the shard's carried state."""
    days = grid.select(quoted(grid_day).cast("date").alias("__day")).where("__day is not null").groupBy("__day").agg(F.lit(1).alias("__one")).select("__day", shard(F.col("__day")).alias("__shard")).groupBy("__shard").agg(F.collect_set("__day").alias("__days"))
    return shards.join(days, "__shard").select("__src", "__shard", F.explode(F.filter("__days", wanted)).alias("__day"), *carried)


def regularize_steps(readings: DataFrame, source: str, at: str, fields: Sequence[str], seconds: int, *, shard_steps: int = 512) -> DataFrame:
    """As ``regularize`` on a grid of steps of so many seconds (counted from 1970): one row per source and step from its first reading to its last.

    Columns: ``source``, ``at`` (timestamp, the step's begin), ``is_missing``, ``<field>`` as last read in the step (of equal times, the greatest values),
    ``<field>_filled``, ``steps_since`` (steps since the last one with a reading). Shards of ``shard_steps`` steps are filled independently.
    """
    epoch = F.lit("1970-01-01").cast("date")
    moment = quoted(at).cast("timestamp")
    # steps are counted like days, so that the same shards, summaries and scans serve
    slot = F.date_add(epoch, F.floor(F.unix_micros(moment) / F.lit(seconds * 1_000_000)).cast("int"))
    rows = readings.select(quoted(source).alias("__of"), slot.alias("__step"), moment.alias("__moment"), *[quoted(f).alias(f"__v{i}") for i, f in enumerate(fields)])
    names = [f"__v{i}" for i in range(len(fields))]
    out = regularize(rows, None, "__of", "__step", names, version="__moment", shard_days=shard_steps)
    begin = F.timestamp_micros(F.datediff("__step", epoch).cast("long") * (seconds * 1_000_000))
    return out.select(F.col("__of").alias(source), begin.alias(at), "is_missing", *[F.col(n).alias(f) for n, f in zip(names, fields)], *[F.col(f"{n}_filled").alias(f"{f}_filled") for n, f in zip(names, fields)], F.col("days_since").alias("steps_since"))
