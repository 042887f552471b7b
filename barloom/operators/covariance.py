"""Covariances of all pairs of series over their common days, by blocked Gram matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barloom.session import stage_table

#: Series of a dense block; stripes of series at most, as long as none has more than MOST_IN_STRIPE.
BLOCK, STRIPES, MOST_IN_STRIPE = 512, 10, 8192

SCHEMA = "sym_a string, sym_b string, cov double, n bigint"


def pairwise_covariance(values: DataFrame, least: int = 20, decimals: int = 8) -> DataFrame:
    """``symbol, date, r`` (a row per series and day) to ``sym_a <= sym_b``, sample covariance over the common days, and their number, ``least`` at least.

    Series are dealt into stripes; a task has two stripes, so a row moves once per stripe and not once per pair. Within a task counts, sums and
    products of a pair of blocks are one product of dense matrices over the days both blocks span. Covariances are rounded, half away from zero.
    """
    some = values.where("symbol is not null and date is not null and r is not null")
    one = some.groupBy("symbol").agg(F.collect_list(F.struct(F.unix_date("date").alias("d"), "r")).alias("p")).where(F.size("p") >= least)
    series = stage_table(one.select("symbol", F.col("p.d").alias("d"), F.col("p.r").alias("r")), "series")  # counted, then dealt
    count = series.count()
    g = max(min(STRIPES, math.ceil(count / BLOCK)), math.ceil(count / MOST_IN_STRIPE), 1)
    # tiles of two stripes come first, they are twice the work of those of one
    mixed = g * (g - 1) // 2
    dealt = series.withColumn("stripe", F.expr(f"pmod(hash(symbol), {g})"))
    tile = F.expr(f"explode(transform(sequence(0, {g - 1}), t -> if(t = stripe, {mixed} + t, (greatest(t, stripe) * (greatest(t, stripe) - 1)) div 2 + least(t, stripe)))) as tile")
    tiles = dealt.select(tile, "stripe", "symbol", "d", "r").withColumn("tile", F.col("tile").cast("int"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(kept) if (kept := list(batches)) else None
        for k in np.unique(rows["tile"].to_numpy()) if rows is not None else ():
            yield from _tile(rows.filter(pc.equal(rows["tile"], int(k))), k >= mixed, least, decimals)

    return tiles.repartitionById(mixed + g, F.col("tile")).mapInArrow(products, SCHEMA)


class _Block:
    """Series of a stripe that begin at about the same time, over the days from ``lo`` to ``hi``."""

    def __init__(self, ranks: np.ndarray, sizes: np.ndarray, days: np.ndarray, r: np.ndarray):
        self.ranks, self.days, self.lo, self.hi = ranks, days, int(days.min()), int(days.max()) + 1
        self.columns = np.repeat(np.arange(len(ranks)), sizes)
        # about each series' own mean, which leaves covariances as they are and keeps digits
        self.r = r - np.repeat(np.add.reduceat(r, np.cumsum(sizes) - sizes) / sizes, sizes)

    def dense(self) -> np.ndarray:
        """Days by series: values, then 1 where there is one."""
        s = len(self.ranks)
        x = np.zeros((self.hi - self.lo, 2 * s))
        x[self.days - self.lo, self.columns] = self.r
        x[self.days - self.lo, self.columns + s] = 1
        return x


def _blocks(rows: pa.Table, calendar: np.ndarray, ranks: np.ndarray) -> list[_Block]:
    lists = rows["d"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    days = np.searchsorted(calendar, lists.flatten().to_numpy())
    r = rows["r"].combine_chunks().flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(np.minimum.reduceat(days, starts), kind="stable")
    out = []
    for at in range(0, len(order), BLOCK):
        own = order[at : at + BLOCK]
        places = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in own])
        out.append(_Block(ranks[own], sizes[own], days[places], r[places]))
    return out


def _tile(rows: pa.Table, single: bool, least: int, decimals: int) -> Iterator[pa.RecordBatch]:
    names = rows["symbol"].to_pylist()
    by_name = sorted(range(len(names)), key=names.__getitem__)
    ranks = np.empty(len(names), dtype=np.int32)
    ranks[by_name] = np.arange(len(names), dtype=np.int32)
    labels = pa.array([names[i] for i in by_name], pa.string())
    calendar = np.unique(rows["d"].combine_chunks().flatten().to_numpy())
    stripe = rows["stripe"].to_numpy()
    sides = [np.flatnonzero(stripe == s) for s in np.unique(stripe)]
    if not single and len(sides) < 2:
        return
    left, right = [_blocks(rows.take(side), calendar, ranks[side]) for side in (sides[0], sides[-1])]
    scale = 10.0**decimals
    for i, a in enumerate(left):
        da = a.dense()
        for j, b in enumerate(right[i:] if single else right):
            lo, hi = max(a.lo, b.lo), min(a.hi, b.hi)
            if hi - lo < least:  # no more common days than that
                continue
            s, same = len(a.ranks), single and not j
            all_ = da[lo - a.lo : hi - a.lo].T @ (da if same else b.dense())[lo - b.lo : hi - b.lo]
            xy, x, y, n = all_[:s, : len(b.ranks)], all_[:s, len(b.ranks) :], all_[s:, : len(b.ranks)], all_[s:, len(b.ranks) :]
            keep = n >= least
            ia, ib = np.nonzero(np.triu(keep) if same else keep)
            m = n[ia, ib]
            c = (xy[ia, ib] - x[ia, ib] * y[ia, ib] / m) / (m - 1) * scale
            c = np.trunc(c + np.copysign(0.5, c)) / scale + 0.0
            ra, rb = a.ranks[ia], b.ranks[ib]
            yield pa.RecordBatch.from_arrays([labels.take(pa.array(np.minimum(ra, rb))), labels.take(pa.array(np.maximum(ra, rb))), pa.array(c), pa.array(m.astype(np.int64))], ["sym_a", "sym_b", "cov", "n"])
