import random

import numpy as np
import pytest

from barloom.llm.packing import pack, pack_documents, sum_of_squares
from barloom.llm.tokens import encoding, VOCABULARY


def slow(sizes, capacity):
    """The rule as stated: try every place and count the squares."""
    bins, out = [], []

    def squares():
        n = {}
        for b in bins:
            if b < capacity:
                n[capacity - b] = n.get(capacity - b, 0) + 1
        return sum(x * x for x in n.values())

    for s in sizes:
        options = []
        for gap in sorted({capacity - b for b in bins if b + s <= capacity}):
            i = max(k for k, b in enumerate(bins) if capacity - b == gap)
            bins[i] += s
            options.append((squares(), 0, gap))
            bins[i] -= s
        bins.append(s)
        options.append((squares(), 1, capacity))
        bins.pop()
        out.append(min(options))
        gap = out[-1][2]
        if gap == capacity:
            bins.append(s)
        else:
            bins[max(k for k, b in enumerate(bins) if capacity - b == gap)] += s
    return bins


def test_rule_against_the_slow_one():
    rng = random.Random(1)
    for _ in range(40):
        c = rng.choice([7, 12, 30])
        sizes = [rng.randint(1, c) for _ in range(60)]
        b = sum_of_squares(np.array(sizes), c)
        used = np.bincount(b, weights=sizes)
        assert used.max() <= c
        assert sorted(used.tolist()) == sorted(slow(sizes, c))


def check(placed, items, capacity):
    whole = {}
    for r in placed:
        whole.setdefault(r["item"], []).append((r.piece, r.from_unit, r.units))
    sizes = {}
    for i, n in items:
        if i is not None and n and n > 0:
            sizes[i] = n
    assert set(whole) == set(sizes)
    for i, parts in whole.items():
        parts.sort()
        assert sum(p[2] for p in parts) == sizes[i] and len(parts) == -(-sizes[i] // capacity)
        assert [p[1] for p in parts] == [k * capacity for k in range(len(parts))]
    spans = {}
    for r in placed:
        spans.setdefault(r.bin_id, []).append((r["at"], r["at"] + r.units))
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(a[1] == b[0] for a, b in zip(x, x[1:])) and x[-1][1] <= capacity
    return len(spans)


@pytest.mark.parametrize("shards", [1, 7, 1024])
def test_every_item_whole_and_once(spark, shards):
    rng = random.Random(2)
    items = [(i, rng.choice([1, 3, 99, 100, 101, 250, 1000, rng.randint(1, 100)])) for i in range(300)] + [(1000, 0), (1001, None), (None, 5), (1002, -3)]
    df = spark.createDataFrame(items, "item long, n long").selectExpr("*", "7 as bin_id")
    placed = pack(df, 100, "item", "n", shards).collect()
    bins = check(placed, items, 100)
    assert bins <= 1.02 * sum(n for i, n in items if i is not None and n and n > 0) / 100 + 3
    again = pack(df, 100, "item", "n", shards).collect()
    assert sorted(tuple(r)[1:] for r in placed) == sorted(tuple(r)[1:] for r in again)


def test_a_row_more_changes_its_own_shard_and_the_last_one(spark):
    rng = random.Random(4)
    items = [(i, rng.randint(1, 100)) for i in range(4000)]
    a, b = ({(r["item"], r.bin_id, r["at"]) for r in pack(spark.createDataFrame(x, "item long, n long"), 100, "item", "n", 8).collect()} for x in (items, [*items, (5000, 50)]))
    done = {x for x in a if x[1] >> 32 < 8}
    assert len(done) > 2500 and len({x[1] >> 32 for x in done - b}) <= 1


def test_one_id_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr("barloom.llm.packing.STEP", 64)
    items = [(1, 37)] * 500 + [(i, 11 + i % 60) for i in range(2, 1000)]
    placed = pack(spark.createDataFrame(items, "item long, n long"), 100, "item", "n", 16).collect()
    assert sum(r["item"] == 1 for r in placed) == 500 and sum(r.units for r in placed) == sum(n for _, n in items)
    used = {}
    for r in placed:
        used[r.bin_id] = used.get(r.bin_id, 0) + r.units
    assert max(used.values()) <= 100 and len(used) <= 1.03 * (sum_of_squares(np.random.default_rng(1).permutation([n for _, n in items]), 100).max() + 1)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "item long, n long"), 10, "item", "n").collect() == []


def test_documents_are_measured_whole(spark):
    texts = [(1, "hello world"), (2, None), (3, ""), (4, "long text " * 3000), (5, "<|endoftext|> is text")]
    placed = pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), 64).collect()
    enc = encoding(VOCABULARY)
    for i, t in texts:
        assert sum(r.units for r in placed if r.doc_id == i) == (len(enc.encode_ordinary(t)) if t else 0)
