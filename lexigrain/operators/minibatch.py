"""Mini-batch k-means over packed vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, materialise
from .packed import assign, check_matrix, first_best, matrix_table, width

ROWS = 50_000  #: rows of batches brought to the driver at once (a batch at least)


def _hash(seed: int, batch: Column) -> Column:
    """A seeded hash of batch and id: 12 hexadecimal digits."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), batch.cast("string"), F.lit(":"), F.col("id").cast("string"))), 1, 12)


def _limit(wanted: int, n: int) -> str:
    """Hashes below this are those of ``wanted`` rows or more of ``n``, but for a chance below 1e-20."""
    share = (wanted + 10 * np.sqrt(wanted) + 100) / n
    return "g" if share >= 1 else f"{int(share * (1 << 48)):012x}"


def minibatch_kmeans(packed: DataFrame, k: int, batch_size: int = 2000, iterations: int = 20, seed: int = 42, decay_absent: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``id, cluster_id, similarity``; centroids ``cluster_id, feature_id, w``).

    Starts are ``k`` rows and batches ``batch_size`` rows (all rows, if fewer),
    the first by a seeded hash.  One scan takes the rows of all batches to a
    table of their own, from which a few batches at a time are brought to the
    driver: ``ROWS`` rows, or one batch, are the bound there.  Each vector of a batch moves its nearest
    centroid by 1/count, counts lasting over batches.  Only features the vector
    has change unless ``decay_absent``; centroids are not normalised.  Ties and
    vectors of zeros go to the smallest cluster.  Raises ValueError unless
    1 <= k <= number of rows.
    """
    n = packed.count()
    if k <= 0 or k > n:
        raise ValueError(f"k must be between 1 and the number of rows ({n}), not {k}")
    w = max(1, width(packed))
    check_matrix(k, w)
    limits = F.array(*[F.lit(_limit(k if it == 0 else batch_size, n)) for it in range(iterations + 1)])
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(iterations)), lambda it: F.struct(it.alias("batch"), _hash(seed, it).alias("h"))), lambda s: s["h"] < F.get(limits, s["batch"]))
    chosen = materialise(packed.select("id", "idx", "val", F.explode(drawn).alias("d")).select("d.batch", "d.h", "id", "idx", "val").repartition("batch"))

    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def batch(it: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The rows of a batch; so many batches come at once as have ``ROWS`` rows together."""
        if it not in held:
            held.clear()
            last = it + max(1, ROWS // batch_size)
            place = F.row_number().over(Window.partitionBy("batch").orderBy("h", "id"))
            wanted = F.when(F.col("batch") == 0, k).otherwise(batch_size)
            some = chosen.where((F.col("batch") >= it) & (F.col("batch") < last)).withColumn("place", place).where(F.col("place") <= wanted)
            got = some.select("batch", "place", "idx", "val").toArrow().sort_by([("batch", "ascending"), ("place", "ascending")]).combine_chunks()
            if got.num_rows:
                lists = [got.column(c).combine_chunks() for c in ("idx", "val")]
                lists = [x.chunk(0) if hasattr(x, "chunk") else x for x in lists]
                (at, idx), (_, val) = ((x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)) for x in lists)
                for i, a, b in zip(got.column("batch").to_pylist(), at, at[1:]):
                    held.setdefault(i, []).append((idx[a:b], val[a:b]))
        if len(held.get(it, ())) < min(k if it == 0 else batch_size, n):
            raise RuntimeError("the hash has drawn fewer rows than a batch")
        return held[it]

    centroids = np.zeros((k, w))
    for c, (idx, val) in enumerate(batch(0)):
        centroids[c, idx] = val
    counts = np.zeros(k)
    for it in range(1, iterations + 1):
        for idx, val in batch(it):
            c = int(first_best((centroids[:, idx] @ val)[None])[0])
            counts[c] += 1
            eta = 1 / counts[c]
            if decay_absent:
                centroids[c] *= 1 - eta
                centroids[c, idx] += eta * val
            else:
                centroids[c, idx] = (1 - eta) * centroids[c, idx] + eta * val
    discard(chosen)
    return assign(packed, centroids, unit=False), matrix_table(packed.sparkSession, centroids)
