"""Bar store on Parquet: one dataset per frequency, partitioned by symbol, with atomic versions and immutable snapshots."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import shutil
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.operators.panel import adjust, latest_factor
from barloom.operators.quality import validate_bars

#: On an update, a missing new value keeps the old one in these columns.
KEPT = ("pre_close", "adj_factor", "turnover_rate", "amount")
TAG = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$")


class ReadOnlyStore(RuntimeError):
    """A snapshot is never written to."""


def merge_bars(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """New rows win; where a kept column is missing in them the old value stays; keys only in ``old`` stay whole. One shuffle."""
    values = [c for c in old.columns if c not in keys]
    both = old.select(*keys, *values, F.lit(0).alias("__new")).unionByName(new.select(*keys, *values, F.lit(1).alias("__new")))
    row = F.struct(*values)
    merged = both.groupBy(*keys).agg(F.max_by(row, "__new").alias("__best"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__new"))).alias(f"__k_{c}") for c in values if c in KEPT])
    return merged.select(*keys, *[(F.coalesce(F.col(f"__best.{c}"), F.col(f"__k_{c}")) if c in KEPT else F.col(f"__best.{c}")).alias(c) for c in values])


class BarStore:
    """Layout: root/bars/<freq>/v-<id>/symbol=.../ plus a CURRENT file naming the version; snapshots are directories of links or copies."""

    def __init__(self, spark: SparkSession, root: str, snapshot: str | None = None):
        self.spark, self.root, self.snapshot = spark, root, snapshot

    # Paths and versions.
    def _home(self) -> str:
        return os.path.join(self.root, "snapshots", self.snapshot) if self.snapshot else self.root

    def _dir(self, freq: str) -> str:
        return os.path.join(self._home(), "bars", freq)

    def _current(self, freq: str) -> str | None:
        try:
            with open(os.path.join(self._dir(freq), "CURRENT")) as f:
                return os.path.join(self._dir(freq), f.read().strip())
        except FileNotFoundError:
            return None

    def _writable(self) -> None:
        if self.snapshot:
            raise ReadOnlyStore(f"snapshot {self.snapshot} is read-only")

    def _commit(self, df: DataFrame, freq: str, source: str) -> int:
        """Write a new version beside the old one, then name it in one rename: readers see the one or the other."""
        old, name = self._current(freq), f"v-{dt.datetime.now(dt.UTC):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:6]}"
        path = os.path.join(self._dir(freq), name)
        df.repartition("symbol").sortWithinPartitions("symbol", "date").write.partitionBy("symbol").parquet(path)
        facts = {r.symbol: {"rows": r.n} for r in self.spark.read.schema(self._schema(df)).parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).collect()}
        with open(os.path.join(path, "_provenance.json"), "w") as f:
            json.dump({"source": source, "updated_at": dt.datetime.now(dt.UTC).isoformat(), "symbols": facts}, f)
        draft = os.path.join(self._dir(freq), f".CURRENT-{uuid.uuid4().hex}")
        with open(draft, "w") as f:
            f.write(name)
        os.replace(draft, os.path.join(self._dir(freq), "CURRENT"))
        # the version before stays until the next write, for those who still read it
        kept = {name, os.path.basename(old or "")}
        for other in os.listdir(self._dir(freq)):
            if other.startswith("v-") and other not in kept:
                shutil.rmtree(os.path.join(self._dir(freq), other), ignore_errors=True)
        return sum(x["rows"] for x in facts.values())

    @staticmethod
    def _schema(df: DataFrame):
        return df.schema

    # Writing.
    def save_bars(self, df: DataFrame, freq: str = "1d", source: str = "") -> int:
        """Replace the symbols in ``df``; others stay. Number of rows stored."""
        self._writable()
        new = validate_bars(df, freq)
        old = self._read(freq)
        if old is not None:
            new = new.unionByName(old.join(new.select("symbol").distinct(), "symbol", "left_anti").select(*new.columns))
        return self._commit(new, freq, source)

    def update_bars(self, df: DataFrame, freq: str = "1d", source: str = "") -> int:
        """Idempotent merge by (symbol, date)."""
        self._writable()
        new = validate_bars(df, freq)
        old = self._read(freq)
        return self._commit(merge_bars(old, new) if old is not None else new, freq, source)

    def save_calendar(self, days: DataFrame) -> None:
        self._writable()
        clean = days.select(F.col("date").cast("date").alias("date")).where("date is not null").distinct().orderBy("date")
        self._replace(clean, "calendar")

    def save_instruments(self, df: DataFrame) -> None:
        """The last row of a symbol holds; rows come in no order, so the greatest one does."""
        self._writable()
        rest = [c for c in df.columns if c != "symbol"]
        clean = df.where("symbol is not null").groupBy("symbol").agg(F.max(F.struct(*rest)).alias("r")).select("symbol", "r.*").orderBy("symbol")
        self._replace(clean, "instruments")

    def _replace(self, df: DataFrame, name: str) -> None:
        path, draft = os.path.join(self.root, name), os.path.join(self.root, f".{name}-{uuid.uuid4().hex}")
        df.coalesce(1).write.parquet(draft)
        past = f"{draft}-old"
        if os.path.exists(path):
            os.rename(path, past)
        os.rename(draft, path)
        shutil.rmtree(past, ignore_errors=True)

    # Reading.
    def _read(self, freq: str) -> DataFrame | None:
        path = self._current(freq)
        if path is None:
            return None
        df = self.spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path)
        return df.withColumn("symbol", F.col("symbol").cast("string"))

    def load_bars(self, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None, freq: str = "1d", columns: Sequence[str] | None = None, adjusted: str = "raw") -> DataFrame:
        """Symbols prune partitions, dates (both inclusive) reach the scan, columns keep their order; qfq takes the factor of the full history."""
        whole = self._read(freq)
        if whole is None:
            raise LookupError(f"no bars of {freq}")
        if symbols is not None:
            whole = whole.where(F.col("symbol").isin(list(symbols)))
        df = whole
        if start is not None:
            df = df.where(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(F.col("date").cast("date") <= F.lit(end).cast("date"))
        df = adjust(df, adjusted, whole)
        if columns is None:
            return df
        lost = [c for c in columns if c not in df.columns]
        if lost:
            raise KeyError(f"no columns {lost}; there are {df.columns}")
        return df.select(*dict.fromkeys(columns))

    def symbols(self, freq: str = "1d") -> list[str]:
        df = self._read(freq)
        return [] if df is None else [r[0] for r in df.select("symbol").distinct().orderBy("symbol").collect()]

    def last_dates(self, freq: str = "1d") -> DataFrame:
        return self._read(freq).groupBy("symbol").agg(F.max("date").alias("last_date"))

    def row_counts(self, freq: str = "1d") -> DataFrame:
        return self._read(freq).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))

    def latest_factors(self, freq: str = "1d") -> DataFrame:
        return latest_factor(self._read(freq))

    def provenance(self, freq: str = "1d") -> dict:
        with open(os.path.join(self._current(freq), "_provenance.json")) as f:
            return json.load(f)

    def load_calendar(self) -> DataFrame | None:
        return self._table("calendar")

    def load_instruments(self) -> DataFrame | None:
        return self._table("instruments")

    def _table(self, name: str) -> DataFrame | None:
        path = os.path.join(self._home(), name)
        return self.spark.read.parquet(path) if os.path.isdir(path) else None

    def search_instruments(self, text: str, limit: int = 20) -> DataFrame:
        return search_instruments(self.load_instruments(), text, limit)

    def incremental_start(self, symbols: Sequence[str], freq: str = "1d") -> dt.date:
        """The day after the earliest last day if all symbols are there (minutes: that day again), else the start of all data."""
        df = self._read(freq)
        if df is None:
            return dt.date(1990, 1, 1)
        r = incremental_start(df, symbols, freq).first()
        return r[0]

    # Snapshots.
    def create_snapshot(self, tag: str) -> str:
        self._writable()
        if not TAG.match(tag):
            raise ValueError("a tag is letters, digits, dot, dash and underscore, 64 at most")
        path = os.path.join(self.root, "snapshots", tag)
        if os.path.exists(path):
            raise FileExistsError(tag)
        draft = f"{path}.draft-{uuid.uuid4().hex}"
        for part in ("bars", "calendar", "instruments"):
            if os.path.isdir(os.path.join(self.root, part)):
                shutil.copytree(os.path.join(self.root, part), os.path.join(draft, part), copy_function=_link)
        os.rename(draft, path)
        return path

    def list_snapshots(self) -> list[str]:
        path = os.path.join(self.root, "snapshots")
        return sorted(x for x in os.listdir(path) if ".draft-" not in x) if os.path.isdir(path) else []

    def delete_snapshot(self, tag: str) -> None:
        self._writable()
        if tag not in self.list_snapshots():
            raise LookupError(tag)
        shutil.rmtree(os.path.join(self.root, "snapshots", tag))


def _link(a: str, b: str) -> None:
    try:
        os.link(a, b)
    except OSError:
        shutil.copy2(a, b)


def search_instruments(instruments: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Symbol contains the text in any case, or name contains it as it is; the first ``limit`` by symbol."""
    hit = F.upper("symbol").contains(text.upper()) | F.coalesce(F.col("name").contains(text), F.lit(False))
    return instruments.where(hit).orderBy("symbol").limit(limit)


def incremental_start(bars: DataFrame, symbols: DataFrame | Sequence[str], freq: str = "1d") -> DataFrame:
    """One row, ``start``. The symbols asked for are a table with that column, or names; they meet the bars by a join."""
    asked = symbols.select("symbol") if isinstance(symbols, DataFrame) else bars.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    last = bars.groupBy("symbol").agg(F.max(F.col("date").cast("date")).alias("d"))
    met = asked.distinct().join(last, "symbol", "left")
    first = F.min("d") if freq != "1d" else F.date_add(F.min("d"), 1)
    return met.agg(F.when((F.count("d") == F.count(F.lit(1))) & (F.count("d") > 0), first).otherwise(F.lit("1990-01-01").cast("date")).alias("start"))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(o).desc_nulls_last() for o in order]))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")
