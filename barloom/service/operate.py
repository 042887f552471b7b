"""What surrounds a run: orders for a broker, a ledger of records, plug-ins, user code in a process of its own, notices."""

from __future__ import annotations

import datetime as dt
import importlib.metadata
import ipaddress
import json
import os
import subprocess
import sys
import tempfile
import urllib.parse
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.service.experiments import safe

#: Groups in which installed distributions announce modules that register factors or sources when they are imported.
GROUPS = {"factors": "barloom.factors", "sources": "barloom.sources"}


def translate_orders(orders: DataFrame, prices: DataFrame, limit: float | None = None, lot: int = 100) -> DataFrame:
    """``orders`` (symbol, side, qty) as a broker takes them: ``quantity`` in whole lots for purchases, ``limit_price`` to three decimals, ``note``.

    The limit is the last price (``prices``: symbol, price; one row each) and ``limit`` more for purchases, less for sales. note is LOT_TOO_SMALL
    where nothing is left, NO_REF_PRICE where a limit is asked for and there is no price, else null. A null or zero quantity is too small.
    """
    asked = F.floor(F.abs(F.coalesce("qty", F.lit(0)).cast("double"))).cast("long")
    quantity = F.when(F.col("side") == "buy", F.floor(asked / lot) * lot).otherwise(asked).cast("long")
    last = prices.select(F.col("symbol").alias("__s"), F.col("price").alias("__p"))
    met = orders.join(last, F.col("symbol") == F.col("__s"), "left").withColumn("quantity", quantity)
    small = F.col("quantity") <= 0

    def priced(share: float) -> Column:
        return F.round(F.col("__p") * F.when(F.col("side") == "buy", 1 + share).otherwise(1 - share), 3)

    price = F.lit(None).cast("double") if limit is None else F.when(~small, priced(limit))
    note = F.when(small, "LOT_TOO_SMALL")
    if limit is not None:
        note = note.when(F.col("__p").isNull(), "NO_REF_PRICE")
    return met.select(*[F.col(c) for c in orders.columns], "quantity", price.alias("limit_price"), note.alias("note"))


def append_ledger(path: str, *records: dict) -> None:
    """One JSON line per record, with the time it was written; lines are only ever added."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    now = dt.datetime.now(dt.UTC).isoformat()
    text = "".join(json.dumps({"ts": now, **{k: safe(v) for k, v in r.items()}}, ensure_ascii=False) + "\n" for r in records)
    handle = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o644)
    try:
        os.write(handle, text.encode())  # in one write, so that records of several writers do not mix
    finally:
        os.close(handle)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a ledger; a line that is no record gives nulls in all columns."""
    return spark.read.schema(schema).json(path)


def discover(group: str | None = None) -> dict[str, dict[str, str]]:
    """Import what installed distributions announce; per group, name -> ``ok`` or the fault. A faulty plug-in stops no other."""
    if group is not None and group not in GROUPS:
        raise ValueError(f"groups are {sorted(GROUPS)}")
    found: dict[str, dict[str, str]] = {}
    for name in [group] if group else GROUPS:
        found[name] = {}
        for point in importlib.metadata.entry_points(group=GROUPS[name]):
            try:
                point.load()
                found[name][point.name] = "ok"
            except Exception as e:
                found[name][point.name] = f"{type(e).__name__}: {e}"
    return found


def run_apart(file: str, arguments: dict, seconds: float = 300.0) -> dict:
    """Run a file's ``main(**arguments)`` in a process of its own and folder of its own; its JSON-safe result, or ``error`` with a code.

    Codes: TIMEOUT (the process is ended), FAILED (it raised; the last line of its message), NO_RESULT (main returned nothing that is JSON).
    """
    script = (
        "import json, runpy, sys\n"
        "value = runpy.run_path(sys.argv[1])['main'](**json.loads(sys.argv[2]))\n"
        "json.dump(value, open(sys.argv[3], 'w'))\n"
    )
    with tempfile.TemporaryDirectory() as folder:
        result = os.path.join(folder, "result.json")
        try:
            done = subprocess.run([sys.executable, "-c", script, os.path.abspath(file), json.dumps(arguments), result], cwd=folder, capture_output=True, text=True, timeout=seconds)
        except subprocess.TimeoutExpired:
            return {"error": {"code": "TIMEOUT", "message": f"ended after {seconds} s"}}
        if done.returncode:
            return {"error": {"code": "FAILED", "message": (done.stderr.strip().splitlines() or ["no message"])[-1]}}
        with open(result) as f:
            text = f.read()
        return {"data": json.loads(text)} if text != "null" else {"error": {"code": "NO_RESULT", "message": "main returned nothing"}}


def check_url(url: str) -> str:
    """The address, if notices may go there: https, a host, and none inside (private, loopback, link-local, reserved, metadata)."""
    parts = urllib.parse.urlparse(url)
    host = parts.hostname or ""
    if parts.scheme != "https" or not host:
        raise ValueError("a notice goes to an https address with a host")
    inside = host == "localhost" or host.endswith((".localhost", ".internal"))
    try:
        inside = inside or not ipaddress.ip_address(host).is_global
    except ValueError:
        pass
    if inside:
        raise ValueError(f"{host} is not outside")
    return url


class Notifier:
    """JSON notices to one address; a key is sent once per ``quiet`` seconds. Failures are counted and told, never raised."""

    def __init__(self, url: str, quiet: float = 60.0, send=None):
        self.url, self.quiet, self.sent, self.failures = check_url(url), quiet, {}, []
        self._send = send or (lambda body: urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=10).close())

    def notify(self, text: str, key: str | None = None, now: float | None = None) -> bool:
        now = dt.datetime.now(dt.UTC).timestamp() if now is None else now
        if key is not None and now - self.sent.get(key, -float("inf")) < self.quiet:
            return False
        try:
            self._send(json.dumps({"text": text}, ensure_ascii=False).encode())
        except Exception as e:
            self.failures.append(f"{type(e).__name__}: {e}")
            return False
        if key is not None:
            self.sent[key] = now
        return True
