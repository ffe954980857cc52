"""All pairs of sparse vectors over a least dot product, and the nearest of each vector, without a shuffle of pairs.

Features are numbered by frequency, the rarest first, and rows are written as
blocks of compressed rows to the folder all executors share.  A task holds one
block and reads the others in turn, so what is moved is the vectors once and
the result, never products of pairs.  The work still grows with the pairs of rows.

Products are summed over the rare features first.  Where the norms of what is
left of both rows cannot lift a sum to what the row still looks for (the least
similarity, or its k-th best so far), the pair is dropped; the others are
finished with their frequent features.  Nothing over the bound is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialise
from .graph import dense_numbers

ENTRIES = 1_000_000  #: entries of a block
ROWS = 1024  #: rows below which a block is not made smaller for the sake of more tasks
CELLS = 130_000  #: sums held at once; this and the next keep to what a core caches
PRODUCTS = 250_000  #: products made at once
WIDE = 16_384  #: frequent features that may be left to the second step
SLACK = 1e-12  #: over the rounding errors of sums


def by_frequency(vectors: DataFrame, id_col: str, key: str, max_df: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(``id, idx, val`` with features numbered from the rarest, in order; the first number of each level of frequency, and their end).

    Features of one row are in no pair and left out, as are those of more than ``max_df`` rows.
    """
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(key).alias("f"), F.col("w").cast("double").alias("w")).where("w <> 0")
    counts = v.groupBy("f").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialise((counts if max_df is None else counts.where(F.col("n") <= max_df)).select(F.struct("n", "f").alias("k")))
    numbers = materialise(dense_numbers(counts, "k", "i").select("k.n", "k.f", "i"))
    discard(counts)
    level = F.floor(F.log2("n") * 2)
    starts = sorted(r["i"] for r in numbers.groupBy(level).agg(F.min("i").alias("i")).collect())
    entries = v.join(numbers.select("f", "i"), "f").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("p"))
    packed = materialise(entries.select("id", F.transform("p", lambda x: x["i"]).alias("idx"), F.transform("p", lambda x: x["w"]).alias("val")))
    return packed, np.array([*starts, numbers.count()])


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


class Block:
    """Compressed rows, the entries of a row in the order of the features."""

    def __init__(self, ids: np.ndarray, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, levels: np.ndarray):
        self.ids, self.ptr, self.idx, self.val, self.levels = ids, ptr, idx, val, levels

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.ptr))

    @cached_property
    def _place(self) -> np.ndarray:
        return (np.searchsorted(self.levels[:-1], self.idx, side="right") - 1) * len(self.ids) + self.row

    @cached_property
    def rest(self) -> np.ndarray:
        """Norm of each row from each level on: levels and 1 by rows."""
        n, k = len(self.ids), len(self.levels) - 1
        s = np.bincount(self._place, self.val * self.val, k * n).reshape(k, n)
        return np.sqrt(np.concatenate([s[::-1].cumsum(0)[::-1], np.zeros((1, n))]))

    @cached_property
    def before(self) -> np.ndarray:
        """Entries of each row under each level: levels and 1 by rows."""
        n, k = len(self.ids), len(self.levels) - 1
        return np.concatenate([np.zeros((1, n), np.int64), np.bincount(self._place, minlength=k * n).reshape(k, n).cumsum(0)])

    @cached_property
    def inverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(features, where each starts and the last ends, rows, values)."""
        order = np.argsort(self.idx, kind="stable")
        f = self.idx[order]
        starts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.empty(0, np.int64)
        return f[starts], np.append(starts, len(f)), self.row[order], self.val[order]


def write_blocks(packed: DataFrame) -> DataFrame:
    """The rows as blocks, one row a block; rows of like rare features lie together, so a row meets near ones early."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, idx, val = [], [], [], []

        def out() -> pa.RecordBatch:
            ptr = np.append(0, np.cumsum(np.concatenate(n)))
            cells = [np.concatenate(ids).astype(np.int64), ptr.astype(np.int64), np.concatenate(idx).astype(np.int32), np.concatenate(val).astype(np.float64)]
            for x in (ids, n, idx, val):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["ids", "ptr", "idx", "val"])

        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                ids.append(b.column(0).to_numpy())
                n.append(np.diff(b.column(1).offsets.to_numpy()))
                idx.append(b.column(1).flatten().to_numpy())
                val.append(b.column(2).flatten().to_numpy(zero_copy_only=False))
                if sum(len(x) for x in idx) >= ENTRIES:
                    yield out()
        if ids:
            yield out()

    rows, entries = packed.agg(F.count("*"), F.coalesce(F.sum(F.size("idx")), F.lit(0))).first()
    n = max(1, -(-entries // ENTRIES), min(3 * packed.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)))
    return materialise(packed.repartitionByRange(n, F.element_at("idx", 1), "id").mapInArrow(run, "ids binary, ptr binary, idx binary, val binary"))


def _read(path: str, levels: np.ndarray) -> Iterator[Block]:
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        for b in pq.ParquetFile(f).iter_batches(1, use_threads=False):
            if b.num_rows:
                cells = [np.frombuffer(b.column(c)[0].as_buffer(), t) for c, t in (("ids", np.int64), ("ptr", np.int64), ("idx", np.int32), ("val", np.float64))]
                yield Block(*cells, levels)


def products(x: Block, y: Block, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of ``x``, rows of ``y``, dot products) of the pairs that reach ``least`` of the row of ``x``; in parts of whole rows of ``x``."""
    feature, starts, rows, vals = y.inverse
    n, levels = len(y.ids), y.levels
    if not len(feature):
        return
    at = np.searchsorted(feature, x.idx)
    at[at == len(feature)] = 0
    found = np.where(feature[at] == x.idx, starts[at + 1] - starts[at], 0)
    first, total = starts[at], np.append(0, np.cumsum(found))
    # the first level from which on no row of y can reach the bound with what is left
    idle = x.rest * y.rest.max(1)[:, None] < least - SLACK
    idle[-1] = True
    cut = idle.argmax(0)
    cut = np.maximum(cut, np.searchsorted(levels[-1] - levels <= WIDE, True))
    for c in np.unique(cut):
        own = np.flatnonzero(cut == c)
        some = x.before[c, own]
        work = np.cumsum(np.maximum(total[x.ptr[own] + some] - total[x.ptr[own]], 1))
        lo = 0
        while lo < len(own):
            done = work[lo - 1] if lo else 0
            hi = min(max(lo + 1, int(np.searchsorted(work, done + PRODUCTS, side="right"))), lo + max(1, CELLS // n))
            q, m = own[lo:hi], hi - lo
            e = _ranges(x.ptr[q], some[lo:hi])
            keys = np.repeat(np.repeat(np.arange(m) * n, some[lo:hi]), found[e])
            p = _ranges(first[e], found[e])
            keys += rows[p]
            sums = np.bincount(keys, np.repeat(x.val[e], found[e]) * vals[p], m * n)
            bound = (least[q] - SLACK)[:, None] - x.rest[c, q][:, None] * y.rest[c]
            hit = np.flatnonzero(sums >= bound.ravel())
            a, b, s = hit // n, hit % n, sums[hit]
            if c < len(levels) - 1 and len(hit):
                s += _finished(x, y, q, a, b, c)
            keep = s >= least[q[a]] - SLACK
            yield q[a[keep]], b[keep], s[keep]
            lo = hi


def _finished(x: Block, y: Block, q: np.ndarray, a: np.ndarray, b: np.ndarray, c: int) -> np.ndarray:
    """Sums over the features from level ``c`` on, of the pairs of ``q[a]`` and ``b``."""
    low, wide = y.levels[c], y.levels[-1] - y.levels[c]
    dense = np.zeros(len(q) * wide)
    lens = np.diff(x.ptr)[q] - x.before[c, q]
    e = _ranges(x.ptr[q] + x.before[c, q], lens)
    dense[np.repeat(np.arange(len(q)) * wide, lens) + x.idx[e] - low] = x.val[e]
    lens, begin, out = np.diff(y.ptr)[b] - y.before[c, b], y.ptr[b] + y.before[c, b], np.zeros(len(a))
    ends, lo = np.cumsum(lens), 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PRODUCTS, side="right")))
        e, k = _ranges(begin[lo:hi], lens[lo:hi]), lens[lo:hi]
        out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), k), dense[np.repeat(a[lo:hi] * wide, k) + y.idx[e] - low] * y.val[e], hi - lo)
        lo = hi
    return out


def _firsts(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row by rounded similarity, ties to the larger id, and their places."""
    order = np.lexsort((-ids, -np.round(s, digits), q))
    q, ids, s = q[order], ids[order], s[order]
    begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    keep = place < k
    return q[keep], ids[keep], s[keep], place[keep]


def _tasks(blocks: DataFrame, run, schema: str) -> DataFrame:
    """A task for each file of blocks; ``run`` maps batches of their numbers."""
    n = len(blocks.inputFiles())
    return blocks.sparkSession.range(0, n, 1, max(1, n)).mapInArrow(run, schema)


def _positive(min_similarity: float) -> None:
    if min_similarity < 1e-10:
        raise ValueError("min_similarity must be positive: pairs without a common feature are not listed")


def nearest(packed: DataFrame, levels: np.ndarray, k: int, min_similarity: float, digits: int = 6) -> DataFrame:
    """``doc_id, neighbor_id, similarity, rank`` (similarity not rounded): the ``k`` most similar others of each row, of ``min_similarity`` or more.

    Similarities are compared after rounding to ``digits``; ties go to the larger neighbour id.
    """
    _positive(min_similarity)
    blocks = write_blocks(packed)
    paths = sorted(blocks.inputFiles())

    def best(x: Block, i: int) -> pa.RecordBatch:
        q, ids, s, place = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        least = np.full(len(x.ids), min_similarity - SLACK)
        for path in paths[i:] + paths[:i]:
            for y in _read(path, levels):
                found = [(q, ids, s)]
                for a, b, t in products(x, y, least):
                    keep = (x.ids[a] != y.ids[b]) & (np.round(t, 12) >= min_similarity)
                    if keep.any():
                        found.append(_firsts(a[keep], y.ids[b[keep]], t[keep], k, digits)[:3])
                q, ids, s, place = _firsts(*[np.concatenate(z) for z in zip(*found)], k, digits)
                full = place == k - 1
                least[q[full]] = np.maximum(min_similarity - SLACK, s[full] - 10.0**-digits)
        return pa.RecordBatch.from_arrays([pa.array(x.ids[q]), pa.array(ids), pa.array(s), pa.array((place + 1).astype(np.int32))], ["doc_id", "neighbor_id", "similarity", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for x in _read(paths[i], levels):
                    yield best(x, i)

    return _tasks(blocks, run, "doc_id bigint, neighbor_id bigint, similarity double, rank int")


def pairs(packed: DataFrame, levels: np.ndarray, min_similarity: float) -> DataFrame:
    """``a, b, similarity`` with a < b of all pairs of ``min_similarity`` (positive) or more."""
    _positive(min_similarity)
    blocks = write_blocks(packed)
    paths = sorted(blocks.inputFiles())
    n = len(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for x in _read(paths[i], levels):
                    least = np.full(len(x.ids), min_similarity - SLACK)
                    # of two files one looks at the other, each at half of them
                    for j in [(i + d) % n for d in range(n // 2 + 1) if 2 * d < n or i < n // 2]:
                        for y in _read(paths[j], levels):
                            for a, b, s in products(x, y, least):
                                a, b = x.ids[a], y.ids[b]
                                keep = (a < b if j == i else a != b) & (np.round(s, 12) >= min_similarity)
                                a, b, s = a[keep], b[keep], s[keep]
                                for lo in range(0, len(a), PRODUCTS):
                                    part = slice(lo, lo + PRODUCTS)
                                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[part], b[part])), pa.array(np.maximum(a[part], b[part])), pa.array(s[part])], ["a", "b", "similarity"])

    return _tasks(blocks, run, "a bigint, b bigint, similarity double")
