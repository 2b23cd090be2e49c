"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Session setting that names the folder of the current run.
RUN_FOLDER = "attest.run.folder"


def local_session(app: str = "attest", cores: str | int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("ATTEST_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names, or, in local mode only, a fresh one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Folders of many folders are listed by a few tasks per core, each taking many, and not by a task per folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def open_folders(spark: SparkSession, n: int) -> Iterator[None]:
    """Tasks that write into at most `n` folders keep them open side by side and do not sort their rows by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever the cluster's file systems keep it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Everything that is settled inside goes to one folder, which is removed at the end.

    Results that are read later must be written before the run ends. Runs may be nested; the inner one is removed first.
    """
    before = spark.conf.get(RUN_FOLDER, None)
    place = f"{shared_folder(spark)}/attest-run-{uuid.uuid4().hex}"
    spark.conf.set(RUN_FOLDER, place)
    try:
        yield place
    finally:
        if before is None:
            spark.conf.unset(RUN_FOLDER)
        else:
            spark.conf.set(RUN_FOLDER, before)
        remove_folder(spark, place)


def settle(df: DataFrame, name: str = "frame") -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    Used where a result feeds several branches or the next round of an iteration: the plan restarts from the table, so
    nothing upstream is computed twice and a lost executor costs no recomputation of earlier steps.
    """
    spark = df.sparkSession
    path = f"{spark.conf.get(RUN_FOLDER, None) or shared_folder(spark)}/attest-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
