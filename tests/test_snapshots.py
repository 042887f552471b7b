import datetime as dt

from barloom.operators.snapshots import series_changes, snapshot_changes
from tests.conftest import rows

S = "k string, x double, y double, change_kind int"


def test_two_snapshots(spark):
    old = spark.createDataFrame([("same", 1.0, 2.0, 1), ("noise", 1.0, 2.0, 1), ("moved", 1.0, 2.0, 1), ("gone", 1.0, 2.0, 1), ("lost", 1.0, 2.0, 1), ("zero", 0.0, 0.0, 1), ("nan", float("nan"), 1.0, 1), (None, 1.0, 1.0, 1), ("same", 1.0, 2.0, 1)], S)
    new = spark.createDataFrame([("same", 1.0, 2.0, 2), ("noise", 1.000000001, 2.0, 2), ("moved", 1.1, 2.2, 2), ("lost", 1.0, None, 2), ("zero", -0.0, 0.0, 2), ("nan", None, 1.0, 2), (None, 1.0, 1.5, 2), ("new", None, None, 2)], S)
    got = rows(snapshot_changes(old, new, ["k"], ["x", "y"]))
    assert got == sorted([("gone", "removed", []), ("new", "added", []), ("moved", "changed", ["x", "y"]), ("lost", "changed", ["y"]), (None, "changed", ["y"])], key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows(snapshot_changes(old.limit(0), new.limit(0), ["k"], ["x"])) == []


def test_series_in_order_of_time(spark):
    t = [dt.datetime(2024, 1, i) for i in (1, 2, 3)]
    data = [("s10", t[2], "a", 1.0), ("s9", t[1], "a", 2.0), ("s9", t[1], "b", 1.0), ("s8", t[0], "a", 2.0), ("s10", t[2], "b", 1.0), ("s10", t[2], "b", 1.0), (None, t[0], "z", 1.0)]
    df = spark.createDataFrame(data, "tag string, at timestamp_ntz, k string, x double")
    assert rows(series_changes(df, "tag", "at", ["k"], ["x"])) == [("s10", "a", "changed", ["x"]), ("s9", "b", "added", [])]
    assert rows(series_changes(df.where("tag = 's8'"), "tag", "at", ["k"], ["x"])) == []
