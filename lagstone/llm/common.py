"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bounds of one Arrow batch.  Texts can be very long, so bytes count too.
BATCH_ROWS, BATCH_BYTES = 16_384, 1 << 21

#: Stands in for a null doc_id inside operators; it sorts before every other id.
NULL_ID = -(2**63)


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


class _Made(threading.local):
    """What the calling thread has staged: operators that run beside it in one session keep their own tables."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def prepare(spark: SparkSession) -> None:
    """For the plans that the session runs: bound the rows and bytes of an Arrow batch, and give shuffle files up when a query has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary one is made and recorded.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lagstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the file system removes it when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _hadoop(spark, path)
    files.deleteOnExit(at)
    _made.paths.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and executors can be lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` returned, once nothing reads them any more."""
    for df in staged:
        path = _paths.pop(df, None)
        if path is not None:
            files, at = _hadoop(df.sparkSession, path)
            files.delete(at, True)


def made() -> int:
    """A mark for ``drop_since``, in the calling thread."""
    return len(_made.paths)


def drop_since(mark: int, keep: DataFrame) -> None:
    """Delete what this thread has staged since ``mark``, but for ``keep``: all that it was made of."""
    own = _paths.get(keep)
    for path in _made.paths[mark:]:
        if path != own:
            files, at = _hadoop(keep.sparkSession, path)
            files.delete(at, True)
    _made.paths[mark:] = [own] if own in _made.paths[mark:] else []


def give_back() -> None:
    """Return what this process has freed to the system: allocators keep it, and workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with freed memory given back before and after: for tasks that take much."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
