"""What the operators of this subpackage share: tables, the shared folder, intermediate tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from cloakframe.sources.scratch import drop_path, scratch_path

#: ASCII white space, as all contracts of this subpackage define words: [^\x20\x09-\x0D]+
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The paths of tables written in each passing() that is open.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside, but for those with lasts=True, are deleted at the end: what is read later may not be made of them."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            drop_path(spark, path)


def written(df: DataFrame, label: str, lasts: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors. lasts: beyond the passing() that it is written in."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if len(_passing) > lasts:
        _passing[-1 - lasts].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out


def counted(df: DataFrame, label: str, n: Column | None = None) -> tuple[DataFrame, int]:
    """written(), and its number of rows (or a sum, n) as seen while it was written: for sizes of parts, where a task that ran twice may count twice."""
    seen = Observation()
    out = written(df.observe(seen, (F.count(F.lit(1)) if n is None else F.coalesce(F.sum(n), F.lit(0))).alias("n")), label)
    return out, seen.get["n"]


def text_batches(spark: SparkSession) -> None:
    """Arrow batches for whole texts: fewer rows than Spark's default of 10000, unless the session has its own number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "500")


def lean(work):
    """A function over Arrow batches that leaves no freed memory behind in its Python worker, which Spark keeps for later tasks."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return run


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets (into those bytes); nulls have no bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Parts of a batch of about `most` bytes of one column each (a longer value makes a part of its own)."""
    _, off = utf8_views(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end
