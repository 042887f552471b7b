"""The driver contract: importable without a session, whole tables, results as the SQL's on the smallest data."""

import glob
import math
import os
import subprocess
import sys

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_need_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100; print(len(q))"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{float(v):.8g}") + 0.0
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_results_equal_those_of_sql(spark):
    import duckdb

    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    wrong = []
    queries, texts = e.queries(), e.oracle_sql()
    picked = [q for q in queries if q in texts and q[0] == "p"] + ["i14_kdj", "f06_atr_ratio", "a01_rank_ic", "b01_backtest", "e01_buy_and_hold", "a15_health", "j14_event_windows", "k02_upsert", "w17_drifted", "m03_splits"]
    for q in picked:
        df = queries[q](spark, SF)
        cols = sorted(df.columns)
        mine = sorted(([plain(r[x]) for x in cols] for r in df.collect()), key=str)
        r = c.execute(texts[q])
        names = [x[0] for x in r.description]
        theirs = sorted(([plain(x[names.index(k)]) for k in cols] for x in r.fetchall()), key=str)
        if sorted(names) != cols or mine != theirs:
            wrong.append(q)
    assert not wrong
