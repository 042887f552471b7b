"""Differences between two copies of a table whose keys may repeat."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.functions.clean import TOLERANCE, differ, quoted
from barloom.operators.pairing import pair_rows
from barloom.session import stage_table

#: Up to so many left-over rows on a side, a key is paired by assignment over the matrix of all pairs, beyond by flows; both are exact.
EXACT_ROWS = 400


def assign(cost: np.ndarray) -> list[int]:
    """Minimum-cost assignment of rows to columns (rows <= columns); column of each row. Shortest augmenting paths, O(n^2 m)."""
    n, m = cost.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            now = cost[i0 - 1] - u[i0] - v[1:]
            free = ~used[1:]
            better = free & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    found = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            found[owner[j] - 1] = j - 1
    return found


def _unlike(a: np.ndarray, b: np.ndarray, tolerance: float, numeric: bool) -> np.ndarray:
    """Matrix of where the values of one field differ."""
    na, nb = pd.isna(a)[:, None], pd.isna(b)[None, :]
    if numeric:
        x, y = a.astype(float)[:, None], b.astype(float)[None, :]
        with np.errstate(invalid="ignore"):
            apart = np.abs(x - y) > tolerance * np.maximum(np.abs(x), np.abs(y))
    else:
        apart = a.astype(object)[:, None] != b.astype(object)[None, :]
    return np.where(na | nb, na != nb, apart)


def diff_copies(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], *, tolerance: float = TOLERANCE, repeats: str = "count", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """One row per difference: the keys, ``kind``, ``field``, ``left_value``, ``right_value`` (text), ``n``.

    kind is ``only_left``/``only_right`` (the key is absent on the other side; n rows), ``surplus_left``/``surplus_right`` (the key is on
    both sides, this copy of it has no partner) or ``value`` (a paired row whose field differs).

    Identical rows cancel by multiplicity. What is left is paired within each key so that the number of differing fields is least; a key
    with one row left on each side needs no search, a key with up to ``exact_rows`` rows left a side is assigned over the matrix of its
    pairs, and a larger one by a cheapest flow over its distinct rows, of the same cost but without that matrix; either way a key is
    paired in one task. With ``repeats="once"`` equal rows on a side count once.

    Nulls: a null key equals a null key; NaN is missing; two missing values are equal, a missing and a present one differ. Empty sides
    are fine. Other columns of either side are ignored, so clashing names do no harm.
    """
    if repeats not in ("count", "once"):
        raise ValueError("repeats is 'count' or 'once'")
    types = {f.name: f.dataType for f in left.schema.fields}
    numeric = {f: isinstance(types[f], T.NumericType) for f in fields}
    ks, fs = [f"__k{i}" for i in range(len(keys))], [f"__f{i}" for i in range(len(fields))]

    def side(df: DataFrame, mark: int) -> DataFrame:
        cols = [quoted(k).alias(n) for k, n in zip(keys, ks)]
        for f, n in zip(fields, fs):
            c = quoted(f).cast("double") if numeric[f] else quoted(f)
            # adding zero makes -0.0 and 0.0 one value
            cols.append((F.when(~F.isnan(c), c + F.lit(0.0)) if numeric[f] else c).alias(n))
        return df.select(*cols, F.lit(mark).alias("__left"), F.lit(1 - mark).alias("__right"))

    both = side(left, 1).unionByName(side(right, 0))
    total = F.max if repeats == "once" else F.sum
    classes = both.groupBy(*ks, *fs).agg(total("__left").cast("long").alias("__nl"), total("__right").cast("long").alias("__nr"))
    rest = classes.select(*ks, *fs, "__nl", "__nr", F.greatest(F.col("__nl") - F.col("__nr"), F.lit(0)).alias("__rl"), F.greatest(F.col("__nr") - F.col("__nl"), F.lit(0)).alias("__rr"))
    values = F.struct(*fs)
    per_key = rest.groupBy(*ks).agg(
        F.sum("__nl").alias("__nl"),
        F.sum("__nr").alias("__nr"),
        F.sum("__rl").alias("__rl"),
        F.sum("__rr").alias("__rr"),
        F.count_if(F.col("__rl") > 0).alias("__cl"),
        F.count_if(F.col("__rr") > 0).alias("__cr"),
        F.max(F.when(F.col("__rl") > 0, values)).alias("__l"),
        F.max(F.when(F.col("__rr") > 0, values)).alias("__r"),
    )
    absent = (F.col("__nl") == 0) | (F.col("__nr") == 0)
    plain = absent | ((F.col("__cl") <= 1) & (F.col("__cr") <= 1))

    def entry(when: Column, kind: str, field: str | None, lv: Column, rv: Column, n: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"), lv.cast("string").alias("left_value"), rv.cast("string").alias("right_value"), n.cast("long").alias("n")))

    none = F.lit(None).cast("string")
    pairs = F.least("__rl", "__rr")
    found = [
        entry(F.col("__nr") == 0, "only_left", None, none, none, F.col("__nl")),
        entry(F.col("__nl") == 0, "only_right", None, none, none, F.col("__nr")),
        entry(~absent & (F.col("__rl") > F.col("__rr")), "surplus_left", None, none, none, F.col("__rl") - F.col("__rr")),
        entry(~absent & (F.col("__rr") > F.col("__rl")), "surplus_right", None, none, none, F.col("__rr") - F.col("__rl")),
    ]
    for f, n in zip(fields, fs):
        a, b = F.col(f"__l.{n}"), F.col(f"__r.{n}")
        apart = differ(a, b, tolerance) if numeric[f] else ~a.eqNullSafe(b)
        found.append(entry(~absent & (pairs > 0) & apart, "value", f, a, b, pairs))
    found = F.filter(F.array(*found), lambda x: x.isNotNull())
    noted = per_key.select(*ks, (~plain).alias("__crowd"), F.greatest("__rl", "__rr").alias("__most"), F.when(plain, found).alias("__found")).where("__crowd or size(__found) > 0")
    noted = stage_table(noted, "copydiff")  # differences only: small, and asked twice
    columns = ["kind", "field", "left_value", "right_value", "n"]
    out = noted.where("not __crowd").select(*ks, F.explode("__found").alias("x")).select(*ks, *[F.col(f"x.{c}") for c in columns])

    most = noted.where("__crowd").agg(F.min("__most"), F.max("__most")).first()
    if most[0] is not None:
        crowded = noted.where("__crowd").select(*[F.col(k).alias(f"__c{k}") for k in ks], (F.col("__most") <= exact_rows).alias("__exact"))
        same = [F.col(k).eqNullSafe(F.col(f"__c{k}")) for k in ks]
        many = rest.where((F.col("__rl") > 0) | (F.col("__rr") > 0)).join(crowded, same).select(*ks, *fs, "__rl", "__rr", "__exact")
        if most[0] <= exact_rows:
            out = out.unionByName(_assigned(many.where("__exact"), ks, fs, fields, numeric, tolerance))
        if most[1] > exact_rows:
            out = out.unionByName(_flowed(many.where("not __exact"), ks, fs, fields, numeric, tolerance))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, ks)], *columns)


def _assigned(many: DataFrame, ks: list[str], fs: list[str], fields: Sequence[str], numeric: dict[str, bool], tolerance: float) -> DataFrame:
    """Exact pairing of the keys with few rows left; one row per pair and field, equal ones summed up at the end."""
    schema = T.StructType([*[many.schema[k] for k in ks], *[T.StructField(c, T.StringType()) for c in ("kind", "field", "left_value", "right_value")], T.StructField("n", T.LongType())])

    def text(x: object) -> str | None:
        return None if pd.isna(x) else str(x)

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[k].iloc[0] for k in ks]
        a, b = (pdf[pdf[c] > 0].sort_values(fs) for c in ("__rl", "__rr"))
        a, b = a.loc[a.index.repeat(a["__rl"])], b.loc[b.index.repeat(b["__rr"])]
        rows: list[list] = []
        if len(a) and len(b):
            unlike = [_unlike(a[n].to_numpy(), b[n].to_numpy(), tolerance, numeric[f]) for f, n in zip(fields, fs)]
            cost = np.sum(unlike, axis=0).astype(float)
            turned = len(a) > len(b)
            for p, q in enumerate(assign(cost.T if turned else cost)):
                x, y = (q, p) if turned else (p, q)
                rows += [["value", f, text(a[c].iloc[x]), text(b[c].iloc[y]), 1] for f, c, m in zip(fields, fs, unlike) if m[x, y]]
        for kind, n in (("surplus_left", len(a) - len(b)), ("surplus_right", len(b) - len(a))):
            rows += [[kind, None, None, None, n]] * (n > 0)
        return pd.DataFrame([[*key, *r] for r in rows], columns=schema.names)

    columns = ["kind", "field", "left_value", "right_value"]
    return many.groupBy(*ks).applyInPandas(pair, schema).groupBy(*ks, *columns).agg(F.sum("n").alias("n"))


def _flowed(many: DataFrame, ks: list[str], fs: list[str], fields: Sequence[str], numeric: dict[str, bool], tolerance: float) -> DataFrame:
    """Least-cost pairing of the very crowded keys, from their distinct rows and how often each is left, by flows through hubs of agreeing fields."""
    sides = [f"{mark}{n}" for mark in "ab" for n in fs]
    schema = T.StructType([*[many.schema[k] for k in ks], *[T.StructField(c, many.schema[c[1:]].dataType) for c in sides], T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf[c] > 0].sort_values(fs).reset_index(drop=True) for c in ("__rl", "__rr"))
        have, want = a["__rl"].tolist(), b["__rr"].tolist()
        met = pair_rows([a[n].to_numpy() for n in fs], [b[n].to_numpy() for n in fs], have, want, [numeric[f] for f in fields], tolerance)
        i, j, n = (np.array(x, dtype=int) for x in (zip(*met) if met else ([], [], [])))
        rows = pd.concat([a[fs].take(i).set_axis(sides[:len(fs)], axis=1).reset_index(drop=True), b[fs].take(j).set_axis(sides[len(fs):], axis=1).reset_index(drop=True)], axis=1)
        rows["kind"], rows["n"] = "value", n
        rest = [{"kind": kind, "n": sum(x)} for kind, x in (("surplus_left", have), ("surplus_right", want)) if any(x)]
        if rest:
            rows = pd.concat([rows, pd.DataFrame(rest)], ignore_index=True)
        for k in ks:
            rows[k] = pd.Series([pdf[k].iloc[0]] * len(rows), dtype=pdf[k].dtype)
        return rows[schema.names]

    entries = [F.when(F.col("kind") != "value", F.struct("kind", *[F.lit(None).cast("string").alias(c) for c in ("field", "left_value", "right_value")]))]
    for f, n in zip(fields, fs):
        x, y = F.col(f"a{n}"), F.col(f"b{n}")
        apart = differ(x, y, tolerance) if numeric[f] else ~x.eqNullSafe(y)
        entries.append(F.when((F.col("kind") == "value") & apart, F.struct("kind", F.lit(f).alias("field"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value"))))
    met = many.groupBy(*ks).applyInPandas(pair, schema)
    rows = met.select(*ks, "n", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("x")).select(*ks, "x.*", "n")
    return rows.groupBy(*ks, "kind", "field", "left_value", "right_value").agg(F.sum("n").alias("n"))
