"""Cells of rows that are compared with each other, with hot cells split exactly.

A cell above the cap is cut into chunks; every pair of chunks becomes a cell of
its own, so each pair of rows still meets exactly once and no task holds more
than two chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_cells(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """``key, chunks`` of the cells with more than ``cap`` rows; counted with partial sums."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > cap).select(key, F.ceil(F.col("n") / cap).cast("int").alias("chunks"))


def split_hot(rows: DataFrame, hot: DataFrame, key: str, id_col: str) -> DataFrame:
    """Adds ``chunk``, ``c1``, ``c2``: the row's chunk and the pair of chunks of the cell it is copied to.

    Rows of other cells have chunk 0 and the single cell (0, 0).  In a cell of
    two chunks only rows of different chunks are to be compared.
    """
    m = F.coalesce(F.col("chunks"), F.lit(1))
    chunk = F.pmod(F.xxhash64(id_col), m).cast("int")
    with_chunk = rows.join(hot, key, "left").withColumn("chunk", chunk).withColumn("_o", F.explode(F.sequence(F.lit(0), m - 1)))
    return with_chunk.withColumn("c1", F.least("chunk", "_o").cast("int")).withColumn("c2", F.greatest("chunk", "_o").cast("int")).drop("_o", "chunks")


def by_cell(
    keys: int, work: Callable[[pa.Table], pa.RecordBatch | None], bulk: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None] | None = None, small: int = 64
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that calls ``work`` with all rows of each cell of two rows or more.

    Its input is sorted by the first ``keys`` columns, which name the cell.
    Cells of up to ``small`` rows go to ``bulk``, if given, many at a time, with
    the number of its cell for each row.
    """

    def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts and sum(p.num_rows for p in parts) > 1:
            out = work(pa.Table.from_batches(parts).combine_chunks())
            if out is not None and out.num_rows:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the open cell, which the next batch may continue
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
            new = np.zeros(b.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            starts = np.append(np.append(0, np.flatnonzero(new)), b.num_rows)
            first = 0
            if tuple(c[0] for c in cols) == last:
                held.append(b.slice(0, int(starts[1])))
                first = 1
            if first == len(starts) - 1:
                continue  # all of the batch belongs to the open cell
            yield from flush(held)
            sizes = np.diff(starts)
            complete = np.arange(first, len(sizes) - 1)
            if bulk is not None:
                many = complete[(sizes[complete] > 1) & (sizes[complete] <= small)]
                if len(many):
                    cell = np.repeat(np.arange(len(many)), sizes[many])
                    rows = np.arange(len(cell)) - np.repeat(np.cumsum(sizes[many]) - sizes[many], sizes[many]) + np.repeat(starts[many], sizes[many])
                    out = bulk(pa.Table.from_batches([b]).take(pa.array(rows)), cell)
                    if out is not None and out.num_rows:
                        yield out
                complete = complete[sizes[complete] > small]
            for k in complete:
                yield from flush([b.slice(int(starts[k]), int(sizes[k]))])
            held, last = [b.slice(int(starts[-2]), int(sizes[-1]))], tuple(c[-1] for c in cols)
        yield from flush(held)

    return run
