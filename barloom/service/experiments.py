"""Experiment log on Parquet: append-only rows, configuration as JSON, measures as a map."""

from __future__ import annotations

import datetime as dt
import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.operators.reconcile import compare_runs

SCHEMA = "run_id string, kind string, name string, config string, metrics map<string,double>, snapshot string, notes string, created_at timestamp"


def safe(x):
    """Values that JSON can hold: NaN and infinities as null, times as ISO text."""
    if isinstance(x, dict):
        return {str(k): safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [safe(v) for v in x]
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    if hasattr(x, "item"):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


class Experiments:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, kind: str, name: str, config: dict, metrics: dict[str, float], *, snapshot: str | None = None, notes: str = "", run_id: str | None = None) -> str:
        run_id = run_id or f"{kind}-{uuid.uuid4().hex[:10]}"
        numbers = {k: float(v) for k, v in metrics.items() if v is not None and math.isfinite(v)}
        row = (run_id, kind, name, json.dumps(safe(config), sort_keys=True, ensure_ascii=False), numbers, snapshot, notes, dt.datetime.now())
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return run_id

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def list(self, kind: str | None = None, limit: int = 20) -> DataFrame:
        df = self.table()
        return (df.where(F.col("kind") == kind) if kind else df).orderBy(F.desc("created_at"), "run_id").limit(limit)

    def get(self, run_id: str) -> dict:
        found = self.table().where(F.col("run_id") == run_id).first()
        if found is None:
            raise LookupError(run_id)
        return {**found.asDict(), "config": json.loads(found.config)}

    def compare(self, ids: list[str]) -> DataFrame:
        return compare_runs(self.table(), ids)
