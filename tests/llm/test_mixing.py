import random

import numpy as np

from barloom.llm.mixing import fill_gap, inclusion_scale, mix_documents, next_buckets, plan_mix


def test_plan():
    sizes = {"a": 1000.0, "b": 100.0}
    p = {r["source"]: r for r in plan_mix([("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "none", 0.2, 9)], sizes)}
    assert p["a"]["quota"] == 0.5 * 200 / 0.3 and p["b"]["copies"] == 2 and p["b"]["rest"] == 0 and p["none"]["quota"] == 0
    assert plan_mix([("m", "a", 0.5, 1)], sizes, total=100)[0]["rest"] == 50
    assert plan_mix([("m", "none", 1.0, 3)], {})[0]["copies"] == 0


def test_inclusion_scale():
    rng = np.random.default_rng(1)
    for _ in range(200):
        w, s = rng.random(8) + 0.01, rng.random(8) * 10
        rest = rng.random() * s.sum()
        c = inclusion_scale(list(zip(w, s)), rest)
        assert abs((s * np.minimum(1, c * w)).sum() - rest) < 1e-6
    assert inclusion_scale([(1.0, 5.0)], 5.0) == float("inf")


def test_fill_gap():
    assert fill_gap(np.array([5, 3, 9, 2]), 10).tolist() == [1, 1, 0, 1]
    assert fill_gap(np.array([50, 3]), 40).tolist() == [1, 1] or fill_gap(np.array([50, 3]), 40).tolist() == [0, 1]
    assert fill_gap(np.array([], dtype=int), 4).tolist() == []


def corpus(spark, n=400):
    rng = random.Random(3)
    docs = [(i, rng.choice(["big", "big", "big", "mid", "small"]), "word " * rng.randint(5, 60)) for i in range(n)] + [(9000, "mid", None), (9001, "mid", ""), (9002, None, "x"), (None, "mid", "x")]
    return spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as n_tokens", "2 as copies")


GOALS = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 3), ("n", "small", 0.9, 1), ("n", "absent", 0.1, 5)]


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([*GOALS, GOALS[0]], "mix_name string, source string, target_share double, max_repeats int")
    chosen, report = mix_documents(corpus(spark), targets)
    rows, shares = chosen.collect(), {(r.mix_name, r.source): r for r in report.collect()}
    caps = {(m, s): c for m, s, _, c in GOALS}
    assert rows and all(1 <= r.copies <= caps[r.mix_name, r.source] for r in rows)
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    for (m, s), r in shares.items():
        got = sum(x.copies * x.n_tokens for x in rows if (x.mix_name, x.source) == (m, s))
        assert got == r.tokens
        if m == "m":
            assert abs(r.actual_share - r.target_share) < 0.01
    assert shares["n", "absent"].actual_share == 0 and shares["n", "small"].actual_share == 1
    again, _ = mix_documents(corpus(spark), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    other, _ = mix_documents(corpus(spark), targets, seed=12)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, rows))


def test_heavier_documents_come_more_often(spark):
    docs = spark.createDataFrame([(i, "s", "word " * (10 if i % 2 else 160)) for i in range(1000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("m", "s", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    rows = mix_documents(docs, targets, total=30_000)[0].collect()
    long = sum(r.n_tokens > 50 for r in rows) / len(rows)
    assert 0.7 < long < 0.9  # odds 4 : 1, as the square root of the size
    assert abs(sum(r.n_tokens for r in rows) - 30_000) <= 160


def test_where_a_rest_ends(monkeypatch):
    assert next_buckets([(3, 10, 2), (5, 10, 2), (9, 10, 300), (11, 5, 7)], 15) == (5, 9, 10, 302)
    assert next_buckets([(3, 10, 2), (5, 10, 5000), (9, 10, 300)], 15) == (5, 5, 10, 5000)
    assert next_buckets([(3, 10, 2)], 11) is None and next_buckets([], 1) is None


def test_looking_into_buckets_changes_nothing_but_the_filling(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "s", "word " * (5 + i * 7 % 50)) for i in range(1500)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("m", "s", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    whole = {r.doc_id for r in mix_documents(docs, targets, total=20_000)[0].collect()}
    for name, value in (("STEP_BITS", 3), ("EDGE", 8), ("FOLLOWERS", 2)):
        monkeypatch.setattr(f"barloom.llm.mixing.{name}", value)
    deep = {r.doc_id: r.n_tokens for r in mix_documents(docs, targets, total=20_000)[0].collect()}
    assert len(whole ^ set(deep)) <= 8 and abs(sum(deep.values()) - 20_000) <= 60


def test_repeated_rows_are_one_document_and_certain_ones_are_ranked_too(spark):
    docs = spark.createDataFrame([(7, "s", "word " * 10)] * 300 + [(i, "s", "word " * 10) for i in range(100, 150)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("m", "s", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    chosen = mix_documents(docs, targets, total=400, weight="1e6")[0].collect()
    assert len({r.doc_id for r in chosen}) == len(chosen) and 300 <= sum(r.n_tokens for r in chosen) <= 410


def test_empty(spark):
    targets = spark.createDataFrame([], "mix_name string, source string, target_share double, max_repeats int")
    chosen, report = mix_documents(corpus(spark, 5), targets)
    assert chosen.count() == 0 and report.count() == 0
    one = spark.createDataFrame(GOALS[:1], targets.schema)
    chosen, report = mix_documents(corpus(spark, 5).limit(0), one)
    assert chosen.count() == 0 and report.collect()[0].actual_share == 0
