import datetime as dt
import random

from barloom.operators.asof import known_at
from tests.conftest import rows


def d(i):
    return dt.date(2023, 1, 1) + dt.timedelta(days=i)


KW = dict(event_entity="who", event_time="at", entity="who", known="ann", rank=["period", "ann", "id"], attributes=["id", "v"])


def test_against_brute_force(spark):
    rng = random.Random(4)
    changes = [(i, rng.choice("xyz"), rng.randint(1, 5), d(rng.randint(0, 300)), float(i)) for i in range(60)] + [(99, None, 1, d(1), 1.0), (98, "x", 1, None, 1.0)]
    events = [(i, rng.choice(["x", "y", "z", "none", None]), d(rng.randint(-5, 320))) for i in range(150)] + [(999, "x", None)]
    c = spark.createDataFrame(changes, "id long, who string, period int, ann date, v double")
    e = spark.createDataFrame(events, "event long, who string, at date")
    want = []
    for i, who, at in events:
        usable = [x for x in changes if who is not None and at is not None and x[1] == who and x[3] is not None and x[3] <= at]
        best = max(usable, key=lambda x: (x[2], x[3], x[0]), default=None)
        want.append((i, best[0] if best else None))
    for days in (3, 64):
        got = rows(known_at(e, c, bucket_days=days, **KW).select("event", "id"))
        assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    inner = known_at(e, c, how="inner", **KW)
    assert inner.count() == sum(b is not None for _, b in want)


def test_ties_clashes_and_empty(spark):
    c = spark.createDataFrame([(1, "x", 1, d(5), 1.0), (2, "x", 1, d(5), 2.0), (2, "x", 1, d(5), 2.0)], "id long, who string, period int, ann date, v double")
    e = spark.createDataFrame([(1, "x", d(5), "mine"), (2, "x", d(4), "mine")], "event long, who string, at date, v string")
    assert rows(known_at(e, c, **KW).select("event", "id", "v", "v_known")) == [(1, 2, "mine", 2.0), (2, None, "mine", None)]
    assert rows(known_at(e.limit(0), c, **KW)) == []
    assert [r[0] for r in rows(known_at(e, c.limit(0), **KW).select("event", "id"))] == [1, 2]
