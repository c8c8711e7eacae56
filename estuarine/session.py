"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "estuarine", **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned for; `conf` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for durable intermediates: the session's `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor.
    """
    jsc = spark.sparkContext._jsc.sc()
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-estuarine-", dir="/tmp"))
    return jsc.getCheckpointDir().get()


_SCOPES: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside once the block is left.

    Operators are lazy and read these tables until their results are written, so the writing
    has to happen inside the block.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def store(df: DataFrame) -> str:
    """Write `df` to the shared folder; returns the path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    for scope in _SCOPES[-1:]:
        scope.append(path)
    df.write.parquet(path)
    return path


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a table written by `store` is still complete."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, keeps columnar pruning and
    freezes values such as row positions that a recomputation could change.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row work on input that came as a few small files.

    Input already split into at least as many partitions as there are cores, as any large
    table is, passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
