"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import contextlib
import itertools
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: Files of a folder that the driver deletes by itself.
MANY = 5_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "folioforge") -> SparkSession:
    """A session for tests and local runs; a cluster passes its own session instead."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset
    a new local one, for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is None and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = current.rpartition("/")[0] if current else "file://" + tempfile.mkdtemp(prefix="folioforge-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new place under the shared folder, as a URI."""
    base = shared_dir(spark)
    if "://" not in base:
        base = "file://" + base.removeprefix("file:")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared checkpoint folder and returns a frame that
    reads it: later passes neither recompute nor depend on executors' own disks. Spark deletes the
    files with the frame if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _files(folder: str) -> Iterator[str]:
    """The files under a folder of this machine."""
    with contextlib.suppress(OSError), os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                yield from _files(entry.path)
            else:
                yield entry.path


def _unlinked(spark: SparkSession, folder: str) -> None:
    """Deletes the files under a folder that tasks can reach; each task has a share of them by name."""
    tasks = spark.sparkContext.defaultParallelism

    def unlink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                for file in _files(folder):
                    if zlib.crc32(os.fsencode(file)) % tasks == own:
                        with contextlib.suppress(OSError):
                            os.remove(file)
        yield from ()

    spark.range(0, tasks, 1, tasks).mapInArrow(unlink, "id long").count()


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system Spark can reach. Folders of this machine's hold a file a book, which
    Hadoop deletes some ten times slower; those of many are left to tasks, and what these can't reach to the driver."""
    if path.startswith("file:"):
        local = "/" + path.removeprefix("file:").lstrip("/")
        if os.path.isdir(local):
            if next(itertools.islice(_files(local), MANY, None), None) is not None:
                _unlinked(spark, local)
            shutil.rmtree(local, ignore_errors=True)
        elif os.path.lexists(local):
            os.remove(local)
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """df marked for broadcast if its counted rows are few; else as it is, for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= limit else df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions within send Python batches of so many rows at most: for rows of whole texts or files, of which Spark's usual
    number is too much to hold at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tasks_of_files(spark: SparkSession) -> int:
    """Tasks for rows of many small files."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def of_files(df: DataFrame) -> DataFrame:
    """Rows of many small files, in as many tasks as shuffles have: a scan gives a task to every few files, whatever
    little they hold."""
    return df.coalesce(tasks_of_files(df.sparkSession))


def few(df: DataFrame, rows: int, a_task: int = 100_000) -> DataFrame:
    """df in as many partitions as its counted rows need, for steps that shuffle it: every task before a shuffle
    writes files of its own. As it is if that isn't fewer than the shuffle partitions."""
    tasks = max(1, -(-rows // a_task))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def texts(spark: SparkSession, sf_dir: str, name: str, small: int = 1 << 30) -> DataFrame:
    """A table whose rows cost CPU rather than bytes. One that lies in fewer files than there are
    cores, and is under `small` bytes, is dealt out over the cores first: a file of one row
    group is one task otherwise. Larger tables have files enough and are read as they lie."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if len(df.inputFiles()) < cores and size < small else df


_kept: dict[tuple, object] = {}


def once(spark: SparkSession, name: str, source: DataFrame, build: Callable[[], T]) -> T:
    """What build gives for the files of source, built once in an application."""
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    key = (spark.sparkContext.applicationId, name, size, *sorted(source.inputFiles()))
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]
