"""Helpers that several operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bendpoint.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWEST = -(1 << 63)

BROADCAST_ROWS = 1_000_000
"""Most rows (of a few dozen bytes each) that a helper table may have to be broadcast."""


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. On text of single-byte characters `lower` does the same and is faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def landed(df: DataFrame) -> DataFrame:
    """The rows, written to the cluster's checkpoint folder and read from there by what follows.

    Cuts the lineage in a way that survives lost executors. The files go when the table is no longer
    referenced and the session cleans checkpoints (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a landed table for broadcast if a count proves that it has few rows; else leave it be."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of the table's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_KEPT: list = []
_operator: str | None = None


def kept(maxsize: int) -> Callable:
    """lru_cache for what a worker process keeps from task to task, until it turns to another operator."""

    def mark(func: Callable) -> Callable:
        _KEPT.append(lru_cache(maxsize)(func))
        return _KEPT[-1]

    return mark


def turn_to(operator: str) -> None:
    """Drop what other operators' tasks have left in this worker process."""
    global _operator
    if _operator != operator:
        for cache in _KEPT:
            cache.cache_clear()
        _operator = operator


def _tidy(func: Callable) -> Callable:
    operator = func.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(operator)
        try:
            yield from func(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def arrow_map(df: DataFrame, func: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow whose workers can import this package also where only the driver's path has it.

    On one machine, or with a shared file system, naming the folder is enough; elsewhere ship the
    package with --py-files. A worker holds the caches of one operator at a time.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    return df.mapInArrow(_tidy(func), schema)


@contextmanager
def short_batches(spark: SparkSession, most: int = 1 << 22) -> Iterator[None]:
    """What runs meanwhile sends Python batches of `most` bytes, or a row if that has more; Spark's own bound is 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts without nulls, and where each text starts; then the end."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    return whole, at - at[0]


def bounded(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about max_bytes of text, one row at least."""
    at = text_bytes(batch.column(text))[1]
    low = 0
    while low < batch.num_rows:
        high = max(int(np.searchsorted(at, at[low] + max_bytes, "right")) - 1, low + 1)
        yield batch.slice(low, high - low)
        low = high


def add_columns(
    df: DataFrame, inputs: dict[str, Column], outputs: str, func: Callable, text: str, max_bytes: int
) -> DataFrame:
    """All columns of df, those named like an output replaced, and the outputs (DDL) of func.

    func gets parts of a batch with the columns `inputs`, of which `text` has no nulls, and returns an
    array for each output. Names of the table's own columns clash with nothing.
    """
    new = T.StructType.fromDDL(outputs)
    names = {c.lower() for c in new.names}
    own = [c for c in df.columns if c.lower() not in names]
    given = dict(zip(inputs, fresh_names(df.select(*own), *inputs), strict=True))
    wide = df.select(*own, *[c.alias(given[name]) for name, c in inputs.items()])
    schema = T.StructType([f for f in wide.schema.fields if f.name in own] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, given[text], max_bytes):
                asked = pa.RecordBatch.from_arrays([part.column(c) for c in given.values()], list(given))
                yield pa.RecordBatch.from_arrays([*map(part.column, own), *func(asked)], schema.names)

    return arrow_map(wide, run, schema)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name where the cluster keeps checkpoints, deleted when the driver's JVM ends."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{root}/rows"


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written as compressed Parquet to a scratch folder and read from there, and the folder."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a stored table that nothing will read again, before the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
