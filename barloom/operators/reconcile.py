"""Relational kernels around orders and runs: reconcile, guard, compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.market import in_session

LOT = 100


def reconcile(target: DataFrame, actual: DataFrame, *, sell_untracked: bool = False) -> DataFrame:
    """Orders that bring holdings to targets: buys in whole lots, sells up to what may be sold, ``hold`` where neither is possible.

    ``target``: symbol, target shares. ``actual``: symbol, shares, available. Holdings without target are ``untracked``, sold only on request.
    """
    both = target.select(F.col("symbol").alias("__t"), "target").join(actual.select(F.col("symbol").alias("__a"), "shares", "available"), F.col("__t") == F.col("__a"), "full")
    x = both.select(F.coalesce("__t", "__a").alias("symbol"), "target", F.coalesce("shares", F.lit(0)).alias("shares"), F.coalesce("available", F.lit(0)).alias("available"))
    want = F.col("target") - F.col("shares")
    buy = F.floor(want / LOT) * LOT
    sell = F.least(-want, F.col("available"))
    untracked = F.col("target").isNull()
    action = F.when(untracked, F.when(F.lit(sell_untracked) & (F.col("available") > 0), "sell").otherwise("untracked")).when(want >= LOT, "buy").when((want < 0) & (sell > 0), "sell").otherwise("hold")
    qty = F.when(untracked, F.when(F.lit(sell_untracked), F.col("available")).otherwise(0)).when(want >= LOT, buy).when(want < 0, sell).otherwise(0)
    return x.select("symbol", "target", "shares", "available", action.alias("action"), qty.cast("long").alias("qty"))


def guard(orders: DataFrame, allowed: DataFrame, most: float, at: str = "ts") -> DataFrame:
    """Orders with ``verdict``: NOT_LISTED, CLOSED, TOO_LARGE, else OK, the first rule that applies."""
    marked = orders.join(allowed.select(F.col("symbol").alias("__ok")).distinct(), F.col("symbol") == F.col("__ok"), "left")
    verdict = F.when(F.col("__ok").isNull(), "NOT_LISTED").when(~in_session(F.col(at)), "CLOSED").when(F.col("notional") > most, "TOO_LARGE").otherwise("OK")
    return marked.withColumn("verdict", verdict).drop("__ok")


def fingerprint(symbol: Column, side: Column, qty: Column, price: Column) -> Column:
    """What makes two orders the same: symbol, side, quantity, price to four places."""
    return F.concat_ws("|", F.upper(symbol), side, qty.cast("long").cast("string"), F.format_string("%.4f", price))


def compare_runs(runs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per measure with a column per run; ``runs``: run_id, metrics (map)."""
    long = runs.where(F.col("run_id").isin(list(ids))).select("run_id", F.explode("metrics").alias("metric", "value"))
    return long.groupBy("metric").pivot("run_id", list(ids)).agg(F.max("value"))
