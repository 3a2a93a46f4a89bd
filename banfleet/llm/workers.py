"""Helpers for code that runs in Python workers, and for tables between steps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from banfleet.session import scratch_folder

_STORE = "banfleet_worker_store"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def worker_cache(key, make: Callable):
    """A value kept as long as the Python worker lives, so that tasks share it."""
    store = sys.modules.get(_STORE)
    if store is None:
        store = sys.modules[_STORE] = types.ModuleType(_STORE)
        store.values = {}
    if key not in store.values:
        store.values[key] = make()
    return store.values[key]


def worker_holds(key) -> bool:
    store = sys.modules.get(_STORE)
    return store is not None and key in store.values


def forget() -> None:
    """Drop what :func:`worker_cache` keeps in this worker, and give free memory back to the system.

    For the start of a chain of operators: a worker may still hold what an earlier one needed, like
    a tokenizer with a million pieces.
    """
    store = sys.modules.get(_STORE)
    if store is not None:
        store.values.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Statements run in here delete their shuffle files at their end, instead of when the driver's garbage goes."""
    return _set(spark, _CLEANUP, "true")


def small_batches(spark: SparkSession, size: int) -> contextlib.AbstractContextManager[None]:
    """Statements run in here send at most about ``size`` bytes to a Python worker at once, for rows that are large."""
    return _set(spark, _BATCH, str(size))


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back; cuts the lineage.

    The shuffles that led to it are deleted once it is written. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    with shuffles_removed(spark):
        df.write.options(**options or {}).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written`, once what was made of them has been written too."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more.

    Spark does so when the driver's garbage is collected, which may be long after a large
    step has been written to its table.
    """
    gc.collect()
    spark._jvm.System.gc()


def text_chunks(items: Iterable, limit: int = 1 << 20) -> Iterator[list]:
    """Consecutive items (value, size), cut once their sizes pass ``limit``."""
    chunk, size = [], 0
    for value, n in items:
        chunk.append(value)
        size += n
        if size >= limit:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def joined(texts: list[bytes], gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All bytes after each other, and where each text starts (one more at the end).

    ``gap`` zero bytes follow each text.
    """
    pad = b"\0" * gap
    data = np.frombuffer(b"".join([x + pad for x in texts]) if gap else b"".join(texts), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + gap for x in texts], out=starts[1:])
    return data, starts


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
