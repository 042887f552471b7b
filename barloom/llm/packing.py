"""Items of varying length into containers of fixed capacity: sum-of-squares packing, shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barloom.functions.clean import quoted
from barloom.llm.tokens import VOCABULARY, token_count
from barloom.session import stage_table

#: Shards by the leading bits of a hash of the item, the same whatever the number of items.
SHARDS = 1024
#: A container of a shard is done if at most this share of it is left; the items of the others are packed again, all shards together.
SLACK = 1 / 64
#: Copies of an item id in one step of making them rows of their own.
STEP = 1 << 14


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, in order. Each goes where the squared counts of open bins per residual gap add up to least; ties to the fuller bin.

    Putting size s into a bin of gap g changes the sum by 2 (N[g - s] - N[g]) + 2, or 1 - 2 N[g] if it fills the bin, which then no longer counts;
    a new bin changes it by 2 N[C - s] + 1.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        gap, least = capacity, 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if s < capacity:
            there = np.flatnonzero(count[s:]) + s
            if len(there):
                change = 2 * (count[there - s] - count[there]) + 2
                if there[0] == s:
                    change[0] = 1 - 2 * count[s]
                k = int(np.argmin(change))
                if change[k] <= least:
                    gap = int(there[k])
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        out[i] = b
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return out


def pack(items: DataFrame, capacity: int, item: str, size: str, shards: int = SHARDS) -> DataFrame:
    """``bin_id``, item, ``piece``, ``from_unit``, ``units``, ``at``: where each piece of each item lies.

    Only an item larger than the capacity is split: into full containers and one rest, which is packed like any item. Full pieces are
    containers by themselves. The others go to shards by a hash of the item, within a shard in hashed order, so that repeats of a size do
    not cluster; a task only sees sizes. The number of shards is fixed, so a row more or less changes its own shard only. What a shard leaves in
    containers with more than SLACK of their room unused, a few per gap at most, is packed again by the same rule in one last shard, which
    is thereby bounded by the capacity and the number of shards, not by the data.

    Items of size null, zero or less take no room and are left out, as are null items. Items with the same id and size are counted first and
    packed one by one, spread over all shards. Equal input gives equal containers; full pieces have containers
    with ids below 0, in no fixed order. Empty input gives no rows. Other columns are ignored.
    """
    known = items.select(quoted(item).alias("__item"), quoted(size).cast("long").alias("__size")).where("__item is not null and __size > 0")
    kind = dict(known.dtypes)["__item"]
    same = known.groupBy("__item", "__size").agg(F.count(F.lit(1)).alias("__n"))
    steps = same.select("__item", "__size", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / STEP))).alias("__step"))
    each = steps.select("__item", "__size", F.explode(F.sequence(F.col("__step") * STEP, F.least((F.col("__step") + 1) * STEP, "__n") - 1)).alias("__copy"))
    full, left = F.floor(F.col("__size") / F.lit(capacity)), F.col("__size") % capacity
    mixed = F.xxhash64("__item", "__size", "__copy")
    shared = each.where(left > 0).select("__item", full.alias("piece"), (full * capacity).alias("start"), left.alias("units"), F.pmod(F.shiftrightunsigned(mixed, 32), F.lit(shards)).cast("int").alias("__shard"), mixed.alias("__order"), "__copy")
    whole = each.where(full > 0).select("__item", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
    fields = ["bin_id", "__item", "piece", "from_unit", "units", "at"]
    whole = whole.select((-1 - F.monotonically_increasing_id()).alias("bin_id"), "__item", "piece", (F.col("piece") * capacity).alias("from_unit"), F.lit(capacity).cast("long").alias("units"), F.lit(0).cast("long").alias("at"))

    def placed(part: pd.DataFrame, last: bool) -> pd.DataFrame:
        """One shard packed; ``done`` marks what stays where it is."""
        bins = sum_of_squares(part["units"].to_numpy(), capacity)
        used = np.bincount(bins, weights=part["units"].to_numpy())
        at = part["units"].groupby(bins).cumsum().to_numpy() - part["units"].to_numpy()
        shard = shards if last else int(part["__shard"].iloc[0])
        return part.assign(bin_id=(shard << 32) + bins, at=at, done=last | (used[bins] >= capacity * (1 - SLACK)))

    def by_shard(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard; a shard is packed once the next one begins."""
        rest: list[pd.DataFrame] = []
        for part in parts:
            if not len(part):
                continue
            edge = part["__shard"].iloc[-1]
            if rest and rest[-1]["__shard"].iloc[-1] == edge and part["__shard"].iloc[0] == edge:
                rest.append(part)
                continue
            every = pd.concat([*rest, part], ignore_index=True)
            ready = every[every["__shard"] != edge]
            if len(ready):
                yield pd.concat([placed(g, False) for _, g in ready.groupby("__shard", sort=False)])
            rest = [every[every["__shard"] == edge]]
        if rest:
            yield placed(pd.concat(rest, ignore_index=True), False)

    rows = f"__item {kind}, piece long, start long, units long, __shard int, __order long, __copy long"
    sorted_ = shared.repartition("__shard").sortWithinPartitions("__shard", "__order", "__item", "__copy")
    first = stage_table(sorted_.mapInPandas(by_shard, rows + ", bin_id long, at long, done boolean"), "packed")
    again = first.where("not done").drop("bin_id", "at", "done").coalesce(1).sortWithinPartitions("__order", "__item", "__copy")

    def together(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [p for p in parts if len(p)]
        if every:
            yield placed(pd.concat(every, ignore_index=True), True)

    second = again.mapInPandas(together, rows + ", bin_id long, at long, done boolean")
    both = first.where("done").unionByName(second).withColumnRenamed("start", "from_unit").select(*fields)
    return both.unionByName(whole).withColumnRenamed("__item", item)


def pack_documents(docs: DataFrame, capacity: int = 2048, row_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Whole documents into sequences of ``capacity`` tokens; ``units`` are tokens. Texts are measured once, and only sizes are packed."""
    sized = stage_table(docs.select(quoted(row_id).alias(row_id), token_count(quoted(text), vocabulary).alias("n_tokens")), "sizes")
    return pack(sized, capacity, row_id, "n_tokens")
