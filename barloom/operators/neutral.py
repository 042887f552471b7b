"""Cross-sectional regression residuals on several exposures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def neutralize(df: DataFrame, y: str, exposures: Sequence[str], by: str = "date", out: str = "residual") -> DataFrame:
    """``df`` with the residual of y on the exposures and an intercept, per ``by``.

    NULL for a whole group if an exposure is missing next to a y, or if it has no more rows with y than coefficients. Groups are reduced
    to their moments, a row each; coefficients are solved from these and joined back, so that no group is gathered. Exposures that
    depend on each other linearly share their effect (least norm).
    """
    k = len(exposures)
    names = [*exposures, y]
    there = F.col(y).isNotNull()
    complete = there
    for e in exposures:
        complete = complete & F.col(e).isNotNull()
    group = Window.partitionBy(by)
    ready = df.withColumns({"__n": F.count_if(there).over(group), "__c": F.count_if(complete).over(group)})
    usable = ready.where(there & (F.col("__n") == F.col("__c")) & (F.col("__n") > k + 1))
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s{i}") for i, a in enumerate(names)], *[F.sum(F.col(a) * F.col(b)).alias(f"q{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]]
    moments = usable.groupBy(by).agg(*sums)

    def solve(parts):
        for pdf in parts:
            rows = []
            for r in pdf.to_dict("records"):
                n, s = r["n"], np.array([r[f"s{i}"] for i in range(k + 1)])
                q = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
                c = q / n - np.outer(s, s) / n / n
                scale = np.sqrt(np.maximum(np.diag(c)[:k], 0))
                scale = np.where(scale > 1e-12, scale, 1.0)
                w = np.linalg.lstsq(c[:k, :k] / np.outer(scale, scale), c[:k, k] / scale, rcond=1e-10)[0] / scale
                rows.append([r[by], s[k] / n - float(w @ s[:k]) / n, w.tolist()])
            yield pd.DataFrame(rows, columns=["__by", "__a", "__w"])

    kind = df.schema[by].dataType.simpleString()
    models = moments.mapInPandas(solve, f"__by {kind}, __a double, __w array<double>")
    fitted = F.col("__a")
    for i, e in enumerate(exposures):
        fitted = fitted + F.col(e) * F.col("__w")[i]
    joined = df.join(models, F.col(by) == F.col("__by"), "left")
    return joined.select(*df.columns, (F.col(y) - fitted).alias(out))
