"""Point-in-time datasets and walk-forward splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from barloom.operators.analysis import forward


def stack(wide: DataFrame, value: str, keys: Sequence[str] = ("date",)) -> DataFrame:
    """A wide table (a column per symbol) as long rows, missing cells left out."""
    return wide.unpivot(list(keys), [c for c in wide.columns if c not in keys], "symbol", value).where(F.col(value).isNotNull())


def build_dataset(values: DataFrame, features: Sequence[str], horizon: int = 5, price: str = "h") -> DataFrame:
    """(symbol, date, features, label): features of the day, label the return over the next ``horizon`` rows; rows with anything missing are left out.

    ``values`` is a dense panel with the adjusted price.
    """
    if horizon < 1:
        raise ValueError("horizon is at least 1")
    df = values.select("symbol", "date", *features, forward(F.col(price), horizon).alias("label"))
    return df.dropna(subset=[*features, "label"])


def walk_forward(dates: DataFrame, train: int, test: int, step: int, embargo: int = 0) -> DataFrame:
    """(split, date, part): ``train`` dates, then ``test`` dates, rolled on by ``step`` until the test part no longer fits.

    ``embargo`` dates at the end of the train part are left out, so that labels do not reach into the test part.
    """
    if min(train, test, step) < 1:
        raise ValueError("train, test and step are at least 1")
    placed = dates.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("o"))
    placed = placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    last = F.floor((F.col("n") - train - test) / step)
    lo, hi = F.greatest(F.ceil((F.col("o") - train - test + 1) / step), F.lit(0)), F.least(F.floor(F.col("o") / step), last)
    each = placed.where((F.col("n") >= train + test) & (hi >= lo)).select("date", "o", F.explode(F.sequence(lo, hi)).alias("split"))
    at = F.col("o") - F.col("split") * step
    part = F.when(at < train - embargo, "train").when(at >= train, "test")
    return each.select(F.col("split").cast("int").alias("split"), "date", part.alias("part")).where("part is not null")
