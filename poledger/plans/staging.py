"""Intermediate tables in the cluster's shared folder, so costly steps run once and survive the
loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: list[str] = []  # own folder, only for a local master whose session names none (tests)
_RUNS: dict[str, str] = {}  # folder of each application


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A session on a cluster must name one; a local
    session gets a folder of its own that goes when Python ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def place(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{folder(spark)}/poledger-{app}-{uuid.uuid4().hex}"
        run = spark._jvm.org.apache.hadoop.fs.Path(_RUNS[app])
        store = run.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(run)
        store.deleteOnExit(run)
    return f"{_RUNS[app]}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: they go as soon as the table stands, not when the driver
    happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def write(df: DataFrame, path: str) -> None:
    """Write a table of this application, whose shuffle files nobody reads again."""
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back: later plans scan the written table."""
    path = place(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
