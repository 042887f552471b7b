import importlib.metadata
import json

import pytest

from barloom.service import operate as O
from tests.conftest import rows


def test_orders(spark):
    orders = spark.createDataFrame([("a", "buy", 250.0), ("a", "sell", 250.9), ("b", "buy", 99.0), ("c", "buy", 100.0), ("a", "sell", None)], "symbol string, side string, qty double")
    prices = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "symbol string, price double")
    got = {(r.symbol, r.side, r.qty): tuple(r)[3:] for r in O.translate_orders(orders, prices, 0.02).collect()}
    assert got["a", "buy", 250.0] == (200, 10.2, None) and got["a", "sell", 250.9] == (250, 9.8, None)
    assert got["b", "buy", 99.0] == (0, None, "LOT_TOO_SMALL") and got["c", "buy", 100.0] == (100, None, "NO_REF_PRICE") and got["a", "sell", None][2] == "LOT_TOO_SMALL"
    assert {r.note for r in O.translate_orders(orders, prices).collect()} == {None, "LOT_TOO_SMALL"}


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "live" / "audit.jsonl")
    O.append_ledger(path, {"event": "submit", "qty": 100}, {"event": "fill", "price": float("nan")})
    O.append_ledger(path, {"event": "cancel"})
    assert [json.loads(x)["event"] for x in open(path)] == ["submit", "fill", "cancel"]
    assert rows(O.read_ledger(spark, path, "event string, qty int, price double")) == [("cancel", None, None), ("fill", None, None), ("submit", 100, None)]


def test_plugins(monkeypatch):
    class Point:
        def __init__(self, name, fault=None):
            self.name, self.fault = name, fault

        def load(self):
            if self.fault:
                raise self.fault

    monkeypatch.setattr(importlib.metadata, "entry_points", lambda group: [Point("good"), Point("bad", ImportError("gone"))] if group == "barloom.factors" else [])
    assert O.discover() == {"factors": {"good": "ok", "bad": "ImportError: gone"}, "sources": {}}
    with pytest.raises(ValueError):
        O.discover("other")


def test_code_apart(tmp_path):
    file = tmp_path / "user.py"
    file.write_text("import time\ndef main(n=1, wait=0, bad=False):\n    time.sleep(wait)\n    if bad:\n        raise ValueError('no such bar')\n    return {'n': n + 1} if n else None\n")
    assert O.run_apart(str(file), {"n": 2}) == {"data": {"n": 3}}
    assert O.run_apart(str(file), {"n": 0})["error"]["code"] == "NO_RESULT"
    assert O.run_apart(str(file), {"bad": True})["error"] == {"code": "FAILED", "message": "ValueError: no such bar"}
    assert O.run_apart(str(file), {"wait": 30}, seconds=0.5)["error"]["code"] == "TIMEOUT"


def test_notices():
    for url in ("http://example.org/x", "https://", "https://localhost/x", "https://10.0.0.1/", "https://169.254.169.254/", "https://[::1]/", "https://metadata.google.internal/"):
        with pytest.raises(ValueError):
            O.check_url(url)
    sent = []
    n = O.Notifier("https://example.org/hook", quiet=60, send=sent.append)
    assert n.notify("a", "k", now=0) and not n.notify("a", "k", now=59) and n.notify("a", "k", now=60) and n.notify("b")
    assert [json.loads(x)["text"] for x in sent] == ["a", "a", "b"]

    def fail(body):
        raise OSError("down")

    broken = O.Notifier("https://example.org/hook", send=fail)
    assert not broken.notify("a", "k", now=0) and broken.failures == ["OSError: down"] and broken.sent == {}
