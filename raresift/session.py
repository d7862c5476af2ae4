"""Session helpers: local sessions for tests, shared-folder checkpoints everywhere."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str = "raresift", cores: int | str = 8, memory: str = "16g", **conf: str) -> SparkSession:
    """A single-machine session. On a cluster use the session ``spark-submit`` gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Scorers that run in Python workers need it there, wherever the driver was started from.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="raresift-package-"), "raresift")
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(context.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the session names, else a scratch one in local mode only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="raresift-checkpoint-"))
    return context.getCheckpointDir()


#: Shuffle files go when their query has ended, not when the driver happens to collect its garbage.
CLEAR_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def clearing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside leave no shuffle files. For writes: nothing reads their shuffles again."""
    before = spark.conf.get(CLEAR_SHUFFLES, "false")
    spark.conf.set(CLEAR_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAR_SHUFFLES, before)


def materialise(df: DataFrame, by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once below the checkpoint folder, so that later jobs read it instead of recomputing it.

    With ``by`` the rows of each value of that column lie in a folder of their own. A Parquet table rather than an RDD checkpoint: later jobs read only the columns they need, and the planner
    knows its size. It outlives lost executors just as well.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    with clearing_shuffles(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def release(written: DataFrame) -> None:
    """Remove the files of a table from ``materialise`` that no later step reads."""
    spark = written.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {file[: file.rindex("/")] for file in written.inputFiles()}:
        path = hadoop.Path(spark.sparkContext._jvm.java.net.URI(folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a bare scan out by ``key`` when it has fewer splits than there are cores.

    A file of one row group is read by one task, and so is all work on its rows. A table of many splits, as
    any large one is, is returned as it is. Meant for scans: asking for the splits of a plan with shuffles
    would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def materialise_evenly(df: DataFrame, most: float = 4.0) -> DataFrame:
    """Like ``materialise``, then evened out when few partitions, or one, hold most rows."""
    written = materialise(df)
    sizes = written.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    seen = sizes.agg(F.count(F.lit(1)).alias("filled"), F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not seen.filled or (seen.filled >= cores and seen.largest <= most * seen.rows / seen.filled):
        return written
    return materialise(written.repartition(max(cores, written.rdd.getNumPartitions())))
