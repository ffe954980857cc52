"""Vectors packed by row, and passes over them with a small dense matrix of centroids.

A packed vector is ``id, idx ARRAY<INT>, val ARRAY<DOUBLE>``.  k-means and its
kin need, in every round, all products of vectors with k centroids: one narrow
pass with a matrix product a batch, and sums of ``k`` rows a task, instead of a
join that shuffles every (row, feature, centroid).  The matrix is bounded by
``k`` times the vocabulary and its size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import sorted_merge

MAX_MATRIX = 64_000_000  #: numbers in a matrix of centroids
PRODUCTS = 100_000  #: products made at once; they keep to what a core caches


def pack(vectors: DataFrame, documents: DataFrame, id_col: str = "doc_id", key: str = "feature_id", w: str = "w") -> DataFrame:
    """Packs ``id, feature_id, w`` rows; documents without features get empty arrays."""
    g = vectors.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("int").alias("i"), F.col(w).cast("double").alias("v")))).alias("p"))
    out = documents.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(sorted_merge(g), id_col, "left")
    empty = F.coalesce("p", F.array().cast("array<struct<i:int,v:double>>"))
    return out.select(F.col(id_col).cast("bigint").alias("id"), F.transform(empty, lambda x: x["i"]).alias("idx"), F.transform(empty, lambda x: x["v"]).alias("val"))


def pack_dense(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Packs arrays; null arrays are vectors of zeros, null and NaN elements count as 0."""
    v = F.coalesce(F.col(vec_col).cast("array<double>"), F.array().cast("array<double>"))
    v = F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x))
    idx = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(F.array().cast("array<int>"))
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), idx.alias("idx"), v.alias("val"))


def width(packed: DataFrame) -> int:
    w = packed.agg(F.max(F.array_max("idx"))).first()[0]
    return 0 if w is None else int(w) + 1


class Batch:
    """One Arrow batch of packed vectors as compressed rows."""

    def __init__(self, b: pa.RecordBatch):
        self.ids = b.column(0).to_numpy()
        offsets = b.column(1).offsets.to_numpy().astype(np.int64)
        self.idx = b.column(1).values.to_numpy()[offsets[0] : offsets[-1]] if len(self.ids) else np.empty(0, np.int32)
        o = b.column(2).offsets.to_numpy().astype(np.int64)
        self.val = b.column(2).values.to_numpy(zero_copy_only=False)[o[0] : o[-1]] if len(self.ids) else np.empty(0)
        self.n = np.diff(offsets)
        self.row = np.repeat(np.arange(len(self.ids)), self.n)
        norm = np.sqrt(np.bincount(self.row, self.val * self.val, len(self.ids)))
        self.norm = norm
        self.unit = self.val / np.where(norm > 0, norm, 1)[self.row]

    def times(self, matrix: np.ndarray, unit: bool = True) -> np.ndarray:
        """Products with the rows of ``matrix`` (k by width): one row a vector.

        Dense batches of one length go through a matrix product, others
        through sums over their entries, in blocks that bound the memory.
        """
        k, val = len(matrix), self.unit if unit else self.val
        if len(self.ids) and (self.n == matrix.shape[1]).all() and (self.idx.reshape(len(self.ids), -1) == np.arange(matrix.shape[1])).all():
            return val.reshape(len(self.ids), -1) @ matrix.T
        out, columns = np.zeros((len(self.ids), k)), np.ascontiguousarray(matrix.T)
        rows = np.flatnonzero(self.n)
        ends = np.cumsum(self.n[rows])
        lo = 0
        while lo < len(rows):  # blocks of whole rows
            a = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, a + max(1, PRODUCTS // max(k, 1)), side="right")))
            b = int(ends[hi - 1])
            starts = np.append(a, ends[lo : hi - 1]) - a
            out[rows[lo:hi]] = np.add.reduceat(columns[self.idx[a:b]] * val[a:b, None], starts, axis=0)
            lo = hi
        return out


def first_best(scores: np.ndarray, digits: int = 12) -> np.ndarray:
    """The first of the largest scores of each row, compared after rounding so that the order of summation does not matter."""
    return np.round(scores, digits).argmax(1) if scores.shape[1] else np.zeros(len(scores), int)


def check_matrix(k: int, w: int) -> None:
    if k * w > MAX_MATRIX:
        raise ValueError(f"{k} centroids of {w} features exceed {MAX_MATRIX} numbers; prune the vocabulary (max_features)")


def assign(packed: DataFrame, matrix: np.ndarray, unit: bool = True, moved: dict[int, int] | None = None, digits: int = 6) -> DataFrame:
    """``id, cluster_id, similarity`` of every vector; ties and vectors of zeros go to the smallest cluster."""
    moved = moved or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = Batch(b)
            s = x.times(matrix, unit)
            best = first_best(s)
            for i in np.flatnonzero(np.isin(x.ids, list(moved))) if moved else ():
                best[i] = moved[int(x.ids[i])]
            yield pa.RecordBatch.from_arrays([pa.array(x.ids), pa.array(best.astype(np.int32)), pa.array(np.round(s[np.arange(len(s)), best], digits))], ["id", "cluster_id", "similarity"])

    return packed.select("id", "idx", "val").mapInArrow(run, "id bigint, cluster_id int, similarity double")


def rows_of(packed: DataFrame, ids: list[int], w: int) -> np.ndarray:
    """The unit vectors of some ids (a few, such as seeds) as a dense matrix, in the order given."""
    out = np.zeros((len(ids), w))
    for r in packed.where(F.col("id").isin([int(i) for i in ids])).collect():
        v = np.zeros(w)
        v[np.array(r["idx"], int)] = r["val"]
        n = np.sqrt((v * v).sum())
        for j, i in enumerate(ids):
            if i == r["id"]:
                out[j] = v / n if n > 0 else v
    return out


def matrix_table(spark, matrix: np.ndarray, cluster: str = "cluster_id", key: str = "feature_id") -> DataFrame:
    """Centroids in long form, without zeros."""
    k, f = np.nonzero(matrix)
    schema = T.StructType([T.StructField(cluster, T.IntegerType()), T.StructField(key, T.IntegerType()), T.StructField("w", T.DoubleType())])
    table = pa.table([pa.array(k.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(matrix[k, f])], names=schema.names)
    return spark.createDataFrame(table, schema)
