"""Written intermediate tables and byte views of Arrow text columns, shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnweave.session import scratch_path

ROWS = 1_024  # rows of an Arrow batch that are laid end to end at once
# Settings while a table is written: its shuffle files go afterwards, and Python workers get small batches of long texts.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


_caches: list = []  # what operators keep in a Python worker from task to task


def worker_cache(make: Callable) -> Callable:
    """``make`` with its last result kept by each Python worker for its next tasks; ``slices`` of other work lets it go."""
    held = lru_cache(maxsize=1)(make)
    _caches.append(held)
    return held


def let_go(but: Callable | None = None) -> None:
    """Empties the caches of a Python worker, all ``but`` one: Spark gives a worker to one operator after another."""
    others = [c for c in _caches if c is not but and c.cache_info().currsize]
    for cache in others:
        cache.cache_clear()
    if others:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system; an idle Python worker counts for its executor with all it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Later steps start from storage, so a lost executor repeats its own tasks only. The shuffle files behind a written
    table are of no more use, therefore Spark is told to remove them when the write ends.
    """
    spark = df.sparkSession
    before = {name: spark.conf.get(name, None) for name in WHILE_WRITING}
    for name, value in WHILE_WRITING.items():
        spark.conf.set(name, value)
    path = scratch_path(spark, label)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their exact names, which may hold dots and other signs."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = wide.buffers()
    places = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, most: int, cache: Callable | None = None
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of the batches with about ``most`` bytes of text each (a longer text is a range of its own).

    Of the worker's caches only ``cache`` stays.
    """
    let_go(cache)
    for whole in batches:
        for begin in range(0, whole.num_rows, ROWS):
            batch = whole.slice(begin, ROWS)
            data, offsets = bytes_of(batch.column(batch.schema.get_field_index(column)))
            first, rows = 0, batch.num_rows
            while first < rows:
                last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
                last = min(rows, max(first + 1, last))
                yield (
                    batch.slice(first, last - first),
                    data[offsets[first] : offsets[last]],
                    offsets[first : last + 1] - offsets[first],
                )
                first = last


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
