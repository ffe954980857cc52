"""Sums of arrays over all rows: one array a task, merged in a tree.

A task adds up its rows into one array of doubles and sends that as bytes.
Merging in groups of about the square root of the tasks keeps both the rows a
merging task reads and those that reach the driver few; the driver gets one
array, of the size the caller gives.  Where the arrays of a pass are large
together, they go through the folder all executors share and the driver reads
one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from .scratch import discard, materialise

LARGE = 2_000_000  #: numbers in the arrays of all tasks beyond which they go through the shared folder
DIRECT = 16  #: up to so many tasks, the driver adds their arrays itself


def _one(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())], ["x"])


def summed(df: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], size: int) -> np.ndarray:
    """The array that ``add(total, batch)`` builds up over all batches of ``df``; zeros for an empty table."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                add(total, b)
        yield _one(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), np.float64)
        yield _one(total)

    parts = df.mapInArrow(partial, "x binary")
    tasks = parts.rdd.getNumPartitions()
    total = np.zeros(size)
    if tasks * size > LARGE and tasks <= DIRECT:
        kept = materialise(parts)
        for path in kept.inputFiles():
            fs, at = pa.fs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                for b in pq.ParquetFile(f).iter_batches(1, use_threads=False):
                    for x in b.column(0):
                        total += np.frombuffer(x.as_buffer(), np.float64)
        discard(kept)
        return total
    if tasks > DIRECT:
        parts = parts.repartition(int(np.ceil(np.sqrt(tasks)))).mapInArrow(merge, "x binary").repartition(1).mapInArrow(merge, "x binary")
    for x in parts.toArrow().column(0):
        total += np.frombuffer(x.as_buffer(), np.float64)
    return total
