import datetime as dt

from barloom.functions import clean


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", f("t").alias("x")).orderBy("i").select("x").collect()]


def test_symbols(spark):
    raw = ["600000.SH", "sh.600000", " sh600000\t", "600000Sh", "BJ430001", "６０００００.SH", None, " foo ", ""]
    assert values(spark, clean.canon_symbol, raw) == ["600000.SH"] * 4 + ["430001.BJ", "600000.SH", None, "FOO", ""]
    assert values(spark, clean.canon_code, ["1", " 000123 ", "x", None, "688001"]) == ["000001", "000123", None, None, "688001"]


def test_days(spark):
    d = dt.date(2024, 4, 8)
    raw = ["2024-04-08", "2024/4/8", "2024年4月8日", "20240408", "8 Apr 2024", " ２０２４-０４-０８ ", "2024-04-08 12:30:00", "2024.4.8"]
    assert values(spark, clean.parse_day, raw) == [d] * len(raw)
    assert values(spark, clean.parse_day, ["TBD", "", None, "2024-02-30", "2024-13-01", "20241301", "--", "8 Foo 2024"]) == [None] * 8


def test_periods(spark):
    raw = ["20190331", "2019-03-31", "2019Q1", "2019年一季报", "2019年报", "2019年中报", "2019年三季报", "2019q4", "Q1", None]
    want = [dt.date(2019, 3, 31)] * 4 + [dt.date(2019, 12, 31), dt.date(2019, 6, 30), dt.date(2019, 9, 30), dt.date(2019, 12, 31), None, None]
    assert values(spark, clean.parse_period, raw) == want
