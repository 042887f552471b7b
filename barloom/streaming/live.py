"""Streams: bars built from ticks, idempotent upserts, duplicates within a window, portfolios that go on day by day."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.sim.desk import SCHEMA, Settings, Strategy, resume
from barloom.sources.store import BarStore


def bars_from_ticks(ticks: DataFrame, every: str = "5 minutes", late: str = "10 minutes", symbol: str = "symbol", ts: str = "ts", value: str = "value") -> DataFrame:
    """Open, high, low, close, volume and amount per symbol and window; batch or stream. In a stream, ticks later than ``late`` are not waited for."""
    df = ticks.withWatermark(ts, late) if ticks.isStreaming else ticks
    w = F.window(ts, every)
    agg = df.groupBy(w.alias("w"), F.col(symbol).alias("symbol")).agg(F.min_by(value, ts).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, ts).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"), F.sum(value).alias("amount"))
    return agg.select("symbol", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume", "amount")


def coarser(minutes: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Minute bars to wider ones."""
    w = F.window("date", every)
    agg = minutes.groupBy(w.alias("w"), "symbol").agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"))
    return agg.select("symbol", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume", "amount")


def upsert_into(store: BarStore, freq: str = "1d", source: str = "stream") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: late and corrected bars win; a batch that comes twice changes nothing more; an empty one does nothing."""

    def run(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy("symbol", "date").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in ("symbol", "date")]), "updated_at").alias("r")).select("symbol", "date", "r.*")
        if not latest.isEmpty():
            store.update_bars(latest.drop("updated_at"), freq, source)

    return run


def without_repeats(orders: DataFrame, fingerprint: list[str], ts: str = "ts", within: str = "60 seconds") -> DataFrame:
    """Orders whose fingerprint was not seen within the watermark before."""
    return orders.withWatermark(ts, within).dropDuplicatesWithinWatermark(fingerprint)


def first_alerts(alerts: DataFrame, seconds: float, key: str = "key", ts: str = "ts") -> DataFrame:
    """Alerts that come at least ``seconds`` after the last one passed on with their key; those held back do not start the wait anew."""
    columns = alerts.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        passed, keep = None, []
        for t in pdf[ts]:
            ok = passed is None or (t - passed).total_seconds() >= seconds
            passed = t if ok else passed
            keep.append(ok)
        return pdf[keep][columns]

    return alerts.groupBy(key).applyInPandas(run, alerts.schema)


def portfolios(bars: DataFrame, make: Callable[[str], tuple[Strategy, Settings]], run_id: str = "run_id") -> DataFrame:
    """A stream of bars folded into portfolios, one state per run, kept by the engine; rows as in the batch simulation.

    Each batch carries whole days of a run's bars. The state keeps all days, or as many as the strategy
    says it looks back on.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(parts))
        text, past = state.get if state.exists else (None, None)
        seen = pd.read_json(past, orient="split", convert_dates=["date"]) if past else new.iloc[:0]
        frame = pd.concat([seen, new]).drop_duplicates(["symbol", "date"], keep="first") if len(seen) else new
        strategy, settings = make(key[0])
        text, rows = resume(text, strategy, settings, frame.drop(columns=[run_id], errors="ignore"))
        keep = frame if strategy.lookback is None else frame[frame["date"].isin(sorted(frame["date"].unique())[-strategy.lookback:])]
        state.update((text, keep.to_json(orient="split", date_format="iso")))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        out.insert(0, run_id, key[0])
        yield out.astype({c: float for c in ("qty", "price", "value", "fees", "cash", "pnl")})

    return bars.groupBy(run_id).applyInPandasWithState(step, f"{run_id} string, {SCHEMA}", "book string, past string", "append", GroupStateTimeout.NoTimeout)
