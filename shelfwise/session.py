"""Session helpers: defaults for local runs, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows a dimension may have to be broadcast without Spark's own size estimate
BROADCAST_ROWS = 100_000


def local_session(cpus: int | str = "*", app: str = "shelfwise") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        # one task per core: small test data would otherwise be merged into one task
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SHELFWISE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, a temporary one only if unset and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside go when it is done, not when the driver happens to collect its garbage.

    For tables that are read from where they were written.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def write_table(df: DataFrame, path: str, *keys: str) -> None:
    """Write ``df`` as Parquet, in a folder per value of ``keys``; its shuffle files go with the job."""
    with shuffles_dropped(df.sparkSession):
        df.write.partitionBy(*keys).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_shared_path(df.sparkSession, label)
    _note(path)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scratch = threading.local()


def _note(path: str) -> None:
    paths = getattr(_scratch, "paths", None)
    if paths is not None:
        paths.append(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialize` writes inside, in this thread, are deleted at the end.

    For jobs that have written all they return by then.
    """
    outer, own = getattr(_scratch, "paths", None), []
    _scratch.paths = own
    try:
        yield
    finally:
        _scratch.paths = outer
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``materialize(make(), label)``; tables stored on the way are deleted."""
    path = new_shared_path(spark, label)
    _note(path)
    with scratch(spark):
        df = make()
        write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


#: bytes of text Spark may put into one Arrow batch for a Python worker
ARROW_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not only by rows; a bound the application was started with is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(ARROW_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Redistribute an input that arrives in fewer splits than there are cores.

    Only small files do; a large table is left in its own splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: rows of a table dealt by a key that one task holds, about
TASK_ROWS = 250_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks over which ``df``, a stored table, is dealt by a key: more for a larger one, so that none of them grows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; a larger side is left to Spark's shuffle joins."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
