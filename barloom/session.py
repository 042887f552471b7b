"""Session factory with the settings the operators are designed for."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "barloom", master: str | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """AQE on, UTC, ANSI on; partition counts are upper bounds that AQE coalesces."""
    return (
        SparkSession.builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession, fallback: str = "/tmp/barloom-checkpoints") -> str:
    """The folder of spark.checkpoint.dir if the session names one, else the context's own, else the fallback where all is on one machine.

    On a cluster without the setting this is an error: a folder of one machine would lose the others' rows.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        if spark.sparkContext.getCheckpointDir() is None and not str(getattr(spark.sparkContext, "master", "local")).split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(fallback)
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/barloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STAGED:
        atexit.register(_drop_own)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Sessions and tables this process has staged.
_STAGED: list[tuple[SparkSession, str]] = []


def _drop_own() -> None:
    """At the end of the process its staged tables go, if their session still runs."""
    for spark, path in _STAGED:
        try:
            if spark.sparkContext._jsc is not None:
                target = spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone, and with it the way to delete
            return


def drop_staged(spark: SparkSession) -> int:
    """Delete the staged tables under the checkpoint folder; their number. Only call it when no result is read from them any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("barloom-")]
    for path in found:
        fs.delete(path, True)
    return len(found)
