import itertools
import random
from collections import Counter

import numpy as np

from barloom.operators.copydiff import _unlike, assign, diff_copies
from barloom.operators.pairing import pair_rows
from tests.conftest import rows

SCHEMA = "k string, x double, y double, note string"


def frames(spark, left, right):
    return spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)


def diff(spark, left, right, **kw):
    a, b = frames(spark, left, right)
    return rows(diff_copies(a, b, ["k"], ["x", "y"], **kw).select("k", "kind", "field", "n"))


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = sorted(map(int, rng.integers(1, 6, 2)))
        cost = rng.integers(0, 3, (n, m)).astype(float)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        found = assign(cost)
        assert len(set(found)) == n and sum(cost[i, j] for i, j in enumerate(found)) == best


def test_kinds_and_tolerance(spark):
    left = [("a", 1.0, 2.0, "l"), ("b", 1.0, 2.0, "l"), ("c", 1.0, None, "l"), ("d", 1.0, float("nan"), "l"), (None, 1.0, 1.0, "l")]
    right = [("a", 1.000001, 2.5, "r"), ("c", None, None, "r"), ("d", 1.0, None, "r"), ("e", 0.0, -0.0, "r"), (None, 1.0, 1.0, "r")]
    assert diff(spark, left, right) == [("a", "value", "y", 1), ("b", "only_left", None, 1), ("c", "value", "x", 1), ("e", "only_right", None, 1)]


def test_empty_sides(spark):
    assert diff(spark, [], []) == []
    assert diff(spark, [("a", 1.0, 1.0, "")], []) == [("a", "only_left", None, 1)]
    assert diff(spark, [], [("a", 1.0, 1.0, "")] * 3) == [("a", "only_right", None, 3)]
    assert diff(spark, [], [("a", 1.0, 1.0, "")] * 3, repeats="once") == [("a", "only_right", None, 1)]


def test_repeats_cancel_by_multiplicity(spark):
    left = [("a", 1.0, 1.0, "")] * 3 + [("a", 2.0, 2.0, "")]
    right = [("a", 1.0, 1.0, "")] * 2 + [("a", 2.0, 9.0, "")]
    assert diff(spark, left, right) == [("a", "surplus_left", None, 1), ("a", "value", "y", 1)]
    assert diff(spark, left, right, repeats="once") == [("a", "value", "y", 1)]


def brute(left, right):
    """Least number of differing fields over all pairings, per key."""
    total = 0
    for k in {r[0] for r in left} | {r[0] for r in right}:
        a, b = [r[1:3] for r in left if r[0] == k], [r[1:3] for r in right if r[0] == k]
        if not a or not b:
            continue
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        total += min(sum((x[0] != y[0]) + (x[1] != y[1]) for x, y in zip(a, p)) for p in itertools.permutations(b, len(a)))
    return total


def test_crowded_keys_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(3):
        left = [(rng.choice("ab"), float(rng.randint(0, 2)), float(rng.randint(0, 2)), "") for _ in range(9)]
        right = [(rng.choice("ab"), float(rng.randint(0, 2)), float(rng.randint(0, 2)), "") for _ in range(9)]
        # cancelling equal rows first never costs more: fields then differ in as few places as in the best pairing
        found = diff(spark, left, right)
        assert sum(n for _, kind, _, n in found if kind == "value") == brute(left, right)


def test_very_crowded_keys_keep_every_row(spark):
    rng = random.Random(5)
    left = [("a", float(rng.randint(0, 5)), float(rng.randint(0, 5)), "") for _ in range(80)]
    right = [("a", float(rng.randint(0, 5)), float(rng.randint(0, 5)), "") for _ in range(70)]
    exact, rounds = diff(spark, left, right), diff(spark, left, right, exact_rows=1)
    surplus = [r for r in rounds if r[1] == "surplus_left"]
    assert sum(r[3] for r in surplus) == 10 and not any(r[1] == "surplus_right" for r in rounds)
    cost = [sum(n for _, kind, _, n in x if kind == "value") for x in (exact, rounds)]
    cancelled = sum((Counter(r[1:3] for r in left) & Counter(r[1:3] for r in right)).values())
    assert cost[0] <= cost[1] <= 2 * (70 - cancelled)


def test_flows_cost_as_little_as_assignment():
    rng = np.random.default_rng(7)
    for trial in range(150):
        n, m, k = int(rng.integers(1, 25)), int(rng.integers(1, 25)), int(rng.integers(1, 4))
        tolerance = (1e-5, 0.05)[trial % 2]  # the wide one makes chains in which agreement is not transitive
        sides = []
        for count in (n, m):
            base = rng.integers(-2, 5, (k, count)) * (1 + rng.normal(0, tolerance, (k, count)))
            base[rng.random((k, count)) < 0.1] = np.nan
            sides.append(list(base))
        a, b = sides
        cost = np.sum([_unlike(x, y, tolerance, True) for x, y in zip(a, b)], axis=0).astype(float)
        small = cost if n <= m else cost.T
        best = sum(small[i, j] for i, j in enumerate(assign(small)))
        have, want = [1] * n, [1] * m
        found = pair_rows(a, b, have, want, [True] * k, tolerance)
        assert len({i for i, _, _ in found}) == len({j for _, j, _ in found}) == len(found) == min(n, m)
        assert sum(cost[i, j] for i, j, _ in found) == best and sum(have) == n - min(n, m) and sum(want) == m - min(n, m)


def test_very_crowded_keys_have_the_tolerance_and_least_cost(spark):
    rng = random.Random(11)
    values = [(rng.uniform(1, 100), rng.uniform(1, 100)) for _ in range(401)]
    left = [("hot", x, y, "") for x, y in values]
    right = [("hot", x * (1 + rng.uniform(-4e-6, 4e-6)), y * (1 + rng.uniform(-4e-6, 4e-6)), "") for x, y in values]
    assert diff(spark, left, right) == []
    right[:50] = [("hot", x, y + 500, "") for _, x, y, _ in right[:50]]
    left += [("hot", -5.0, None, "")] * 3
    assert diff(spark, left, right) == [("hot", "surplus_left", None, 3), *[("hot", "value", "y", 1)] * 50]
    coarse = [[("a", float(rng.randint(0, 9)), rng.choice([None, 1.0, 2.0]) and rng.randint(1, 9) * (1 + rng.uniform(-1e-5, 1e-5)), "") for _ in range(n)] for n in (70, 60)]
    cost = [sum(n for _, kind, _, n in diff(spark, *coarse, exact_rows=e) if kind == "value") for e in (400, 1)]
    assert cost[0] == cost[1]


def test_text_fields_and_clashing_columns(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id int, f string, kind int")
    b = spark.createDataFrame([(1, "y", 6)], "id int, f string, kind int")
    assert rows(diff_copies(a, b, ["id"], ["f"])) == [(1, "value", "f", "x", "y", 1)]
