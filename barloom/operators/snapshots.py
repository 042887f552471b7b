"""What changed between full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T, Window

from barloom.functions.clean import TOLERANCE, differ, quoted


def _hashable(df: DataFrame, field: str):
    """A value that is alike for equal readings: doubles at nine significant digits, NaN as missing, no -0.0."""
    c = quoted(field)
    if isinstance(df.schema[field].dataType, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c.cast("double"))
        return F.when(c == 0, "0").otherwise(F.format_string("%.8e", c))
    return c


def changes_between(pairs: DataFrame, keys: Sequence[str], fields: Sequence[str], by: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Changes within ``pairs``, rows tagged by ``__side`` ('old' or 'new'), one comparison per value of ``by``.

    Columns: ``by``, ``keys``, ``change_kind`` (added, removed, changed), ``changed_fields`` (array, empty unless changed).
    One aggregation shuffle: each side's row hash is compared, and only where hashes differ do values decide, within the tolerance.
    Rows repeated on a side count once; if a side holds unequal rows of a key, its greatest row (nulls lowest, fields in order) stands for it.
    """
    old, new = F.col("__side") == "old", F.col("__side") == "new"
    ks = [quoted(k) for k in keys]
    doubles = {f for f in fields if isinstance(pairs.schema[f].dataType, (T.DoubleType, T.FloatType))}
    row = F.struct(*[(F.when(~F.isnan(quoted(f)), quoted(f).cast("double")) if f in doubles else quoted(f)).alias(f"f{i}") for i, f in enumerate(fields)])
    digest = F.xxhash64(*[F.coalesce(_hashable(pairs, f).cast("string"), F.lit("\u0000")) for f in fields])
    grouped = pairs.groupBy(*[quoted(b) for b in by], *ks).agg(
        F.min(F.when(old, digest)).alias("__ho"), F.max(F.when(old, digest)).alias("__ho2"), F.min(F.when(new, digest)).alias("__hn"), F.max(F.when(new, digest)).alias("__hn2"),
        F.max(F.when(old, row)).alias("__o"), F.max(F.when(new, row)).alias("__n"),
    )
    apart = [(differ(F.col(f"__o.f{i}"), F.col(f"__n.f{i}"), tolerance) if f in doubles else ~F.col(f"__o.f{i}").eqNullSafe(F.col(f"__n.f{i}"))) for i, f in enumerate(fields)]
    alike = (F.col("__ho") == F.col("__hn")) & (F.col("__ho2") == F.col("__hn2"))
    changed = F.filter(F.array(*[F.when(a, F.lit(f)) for a, f in zip(apart, fields)]), lambda x: x.isNotNull())
    kind = F.when(F.col("__ho").isNull(), "added").when(F.col("__hn").isNull(), "removed").when(~alike & (F.size(changed) > 0), "changed")
    fields_changed = F.when(F.col("change_kind") == "changed", changed).otherwise(F.array().cast("array<string>"))
    return grouped.withColumn("change_kind", kind).where("change_kind is not null").select(*[quoted(b) for b in by], *ks, "change_kind", fields_changed.alias("changed_fields"))


def snapshot_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Keys added, removed or changed from one full snapshot to the next. Null keys equal null keys; other columns are ignored."""
    cols = [quoted(c) for c in [*keys, *fields]]
    pairs = old.select(*cols, F.lit("old").alias("__side")).unionByName(new.select(*cols, F.lit("new").alias("__side")))
    return changes_between(pairs, keys, fields, [], tolerance)


def series_changes(snapshots: DataFrame, tag: str, order: str, keys: Sequence[str], fields: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Changes from each snapshot to the next one in a table that holds many, ``tag`` naming a snapshot and ``order`` giving their order.

    ``tag`` in the result is that of the later snapshot. The list of snapshots is one row per delivery, never per record; it joins back
    by equality, so that its size decides how. A row of snapshot k serves as 'new' for k and as 'old' for k+1. A tag without rows for a
    key counts as the key's absence; a series of one snapshot has no changes; rows with a null tag are ignored.
    """
    tags = snapshots.where(quoted(tag).isNotNull()).groupBy(quoted(tag).alias("__tag")).agg(F.min(quoted(order)).alias("__at"))
    line = Window.orderBy("__at", "__tag")
    tags = tags.select("__tag", F.lead("__tag").over(line).alias("__next"), F.lag("__tag").over(line).isNotNull().alias("__later"))
    rows = snapshots.select(*[quoted(c) for c in [tag, *keys, *fields]]).join(tags, quoted(tag) == F.col("__tag"))
    roles = F.array(F.when(F.col("__later"), F.struct(F.col("__tag").alias("t"), F.lit("new").alias("s"))), F.when(F.col("__next").isNotNull(), F.struct(F.col("__next").alias("t"), F.lit("old").alias("s"))))
    rows = rows.select(*[quoted(c) for c in [*keys, *fields]], F.explode(F.filter(roles, lambda x: x.isNotNull())).alias("__role"))
    pairs = rows.select(F.col("__role.t").alias(tag), *[quoted(c) for c in [*keys, *fields]], F.col("__role.s").alias("__side"))
    return changes_between(pairs, keys, fields, [tag], tolerance)
