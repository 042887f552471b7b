"""Feeds: binary day files, a registry, a fallback chain, and a Python data source over landed tables."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator, Sequence
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from barloom.operators.quality import validate_bars

#: Fixed value: a record of a day file, little-endian: day, open, high, low, close in hundredths, amount, volume, reserved.
RECORD = np.dtype([("day", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("volume", "<u4"), ("rest", "<u4")])


def parse_day_file(content: bytes) -> pd.DataFrame:
    """Bars of one file; a torn record at the end and records whose day is no date are left out."""
    a = np.frombuffer(content[: len(content) // RECORD.itemsize * RECORD.itemsize], dtype=RECORD)
    out = pd.DataFrame({"date": pd.to_datetime(pd.Series(a["day"]).astype(str), format="%Y%m%d", errors="coerce").dt.date, **{c: a[c] / 100.0 for c in ("open", "high", "low", "close")}, "volume": a["volume"].astype(float), "amount": a["amount"].astype(float)})
    return out[out["date"].notna()]


def read_day_files(spark: SparkSession, path: str) -> DataFrame:
    """All day files under a glob; the symbol is the file's name (sh600000.day is 600000.SH). Files are spread over tasks."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                stem = os.path.splitext(os.path.basename(r.path))[0]
                bars = parse_day_file(bytes(r.content))
                bars.insert(0, "symbol", f"{stem[2:]}.{stem[:2].upper()}")
                yield bars

    return files.mapInPandas(run, "symbol string, date date, open double, high double, low double, close double, volume double, amount double")


class Capability(str, Enum):
    DAILY, MINUTE, CALENDAR, INSTRUMENTS, CONSTITUENTS = "daily", "minute", "calendar", "instruments", "constituents"


class FeedError(RuntimeError):
    """``code`` PARAM stops a fallback chain: another feed would be asked the same wrong question."""

    def __init__(self, code: str, message: str, hint: str = ""):
        super().__init__(f"{code}: {message}" + f" ({hint})" * bool(hint))
        self.code, self.hint = code, hint


class Feed:
    """A feed gives tables; subclasses name themselves and say what they can."""

    name = ""
    capabilities: frozenset[Capability] = frozenset()

    def require(self, what: Capability) -> None:
        if what not in self.capabilities:
            raise FeedError("UNSUPPORTED", f"{self.name} has no {what.value}", f"it has {sorted(c.value for c in self.capabilities)}")

    def fetch(self, spark: SparkSession, symbols: Sequence[str], start: str, end: str, freq: str = "1d") -> DataFrame:
        raise NotImplementedError

    def bars(self, spark: SparkSession, symbols: Sequence[str], start: str, end: str, freq: str = "1d") -> DataFrame:
        """Validated bars of the symbols within the dates."""
        self.require(Capability.DAILY if freq == "1d" else Capability.MINUTE)
        if not symbols:
            raise FeedError("PARAM", "no symbols")
        df = validate_bars(self.fetch(spark, symbols, start, end, freq), freq)
        return df.where(df["symbol"].isin(list(symbols)) & df["date"].between(start, end))


class LandedFeed(Feed):
    """Tables that another process has landed as Parquet or CSV with a header."""

    capabilities = frozenset(Capability)

    def __init__(self, name: str, root: str, standardize: Callable[[DataFrame], DataFrame] | None = None, schema: StructType | str | None = None):
        self.name, self.root, self.standardize, self.schema = name, root, standardize, schema

    def fetch(self, spark: SparkSession, symbols: Sequence[str], start: str, end: str, freq: str = "1d") -> DataFrame:
        base = os.path.join(self.root, freq)
        if glob.glob(f"{base}/**/*.parquet", recursive=True):
            df = spark.read.parquet(base)
        elif glob.glob(f"{base}/*.csv"):
            reader = spark.read.option("header", True)
            df = (reader.schema(self.schema) if self.schema else reader).csv(base)
        else:
            raise FeedError("NO_DATA", f"nothing landed under {base}")
        return self.standardize(df) if self.standardize else df


_FEEDS: dict[str, Callable[..., Feed]] = {}


def register_feed(name: str, make: Callable[..., Feed]) -> None:
    if name in _FEEDS:
        raise ValueError(f"feed {name} exists")
    _FEEDS[name] = make


def feeds() -> list[str]:
    return sorted(_FEEDS)


def create_feed(kind: str, /, **kw) -> Feed:
    if kind not in _FEEDS:
        raise FeedError("PARAM", f"unknown feed {kind}", f"there are {feeds()}")
    return _FEEDS[kind](**kw)


def with_fallback(chain: Sequence[Feed], ask: Callable[[Feed], DataFrame]) -> tuple[str, DataFrame]:
    """The first feed that answers; its name and table. A PARAM error ends the search."""
    last: Exception | None = None
    for feed in chain:
        try:
            return feed.name, ask(feed)
        except FeedError as e:
            if e.code == "PARAM":
                raise
            last = e
        except NotImplementedError as e:
            last = e
    raise FeedError("NO_DATA", "no feed answered", str(last))


class DayFileSource(DataSource):
    """spark.read.format("day_files").option("path", glob): a partition per file."""

    @classmethod
    def name(cls) -> str:
        return "day_files"

    def schema(self) -> str:
        return "symbol string, date date, open double, high double, low double, close double, volume double, amount double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _DayFiles(self.options.get("path", ""))


class _DayFiles(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.path))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            stem = os.path.splitext(os.path.basename(partition.value))[0]
            with open(partition.value, "rb") as f:
                for r in parse_day_file(f.read()).itertuples(index=False):
                    yield (f"{stem[2:]}.{stem[:2].upper()}", *r)
