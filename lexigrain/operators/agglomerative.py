"""Average-linkage clustering by rounds of reciprocal nearest neighbours.

The distance of two clusters is 1 - S / (size * size), S being the sum of the
cosines of their pairs; S of a merged cluster is the sum of its parts', so a
sparse table of S is all that is kept.  Average linkage is reducible: merging
all reciprocal nearest neighbours of a round gives the clusters that merging
one pair at a time would give, where distances do not tie.

Where the vectors are given, S is the dot product of the sums of the clusters'
vectors, so no table of pairs is needed: see :func:`average_linkage`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialise
from . import allpairs
from .graph import dense_numbers
from .similarity import dot

DIGITS = 12
LOCAL = 300_000  #: entries of clusters that one task merges by itself


def cluster_distance(s, size_a, size_b):
    """Mean distance of the pairs of two clusters, from the sum of their cosines."""
    return F.round(1.0 - s / (size_a * size_b), DIGITS)


def agglomerative_clusters(pairs: DataFrame, nodes: DataFrame, threshold: float = 0.65, id_col: str = "doc_id") -> DataFrame:
    """``id, cluster_id`` of every node: clusters merge while the least average distance is at most ``threshold``.

    ``pairs`` holds ``a, b, similarity`` with a < b of all pairs with a positive
    cosine; pairs left out count as distance 1, so the threshold must be below
    1.  Ties go to the pair whose clusters hold the smaller ids.  Single rows are
    numbered first, by id, then merged clusters in the order of their last
    merge.  Null ids are left out, repeated ones count once.
    """
    if threshold >= 1:
        raise ValueError("threshold must be below 1: pairs without a common feature are not listed")
    ids = nodes.select(F.col(id_col).cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    members = materialise(ids.select("id", F.col("id").alias("c")))
    clusters = materialise(ids.select(F.col("id").alias("c"), F.lit(1.0).alias("n"), F.lit(None).cast("double").alias("d"), F.lit(0).alias("round")))
    links = materialise(pairs.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.col("similarity").alias("s")).where("s > 0"))
    done = 0
    while True:
        done += 1
        sizes = clusters.select("c", "n")
        dist = links.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").withColumn("d", cluster_distance(F.col("s"), F.col("na"), F.col("nb"))).where(F.col("d") <= threshold)
        both = dist.select(F.col("a").alias("x"), F.col("b").alias("y"), "d").union(dist.select("b", "a", "d"))
        # the nearest: least distance, then the pair of smallest ids
        near = both.groupBy("x").agg(F.min(F.struct("d", F.least("x", "y").alias("l"), F.greatest("x", "y").alias("g"))).alias("m")).select("x", "m.d", "m.l", "m.g")
        merges = materialise(near.groupBy("l", "g").agg(F.count("*").alias("k"), F.min("d").alias("d")).where("k = 2").select(F.col("g").alias("c"), F.col("l").alias("into"), "d"))
        if not merges.limit(1).count():
            break
        move = merges.select("c", "into")
        to = lambda df, col: df.join(move.toDF(col, "_i"), col, "left").withColumn(col, F.coalesce("_i", col)).drop("_i")
        new_links = to(to(links, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").groupBy("a", "b").agg(F.sum("s").alias("s"))
        grown = to(clusters.select("c", "n"), "c").groupBy("c").agg(F.sum("n").alias("n"))
        last = merges.select(F.col("into").alias("c"), F.col("d").alias("_d"))
        kept = clusters.select("c", "d", "round")
        new_clusters = grown.join(kept, "c").join(last, "c", "left").select("c", "n", F.coalesce("_d", "d").alias("d"), F.when(F.col("_d").isNotNull(), F.lit(done)).otherwise(F.col("round")).alias("round"))
        following = [materialise(x) for x in (new_links, new_clusters, to(members, "c"))]
        for old in (links, clusters, members):
            discard(old)
        links, clusters, members = following
    order = clusters.select("c", F.struct(F.col("d").isNotNull().alias("merged"), F.coalesce("d", F.lit(-1.0)).alias("d"), "c").alias("o"))
    return members.join(dense_numbers(order, "o", "cluster_id").select("c", "cluster_id"), "c").select(F.col("id").alias(id_col), "cluster_id")


def average_linkage(vectors: DataFrame, nodes: DataFrame, threshold: float = 0.65, id_col: str = "doc_id", key: str = "feature") -> DataFrame:
    """As :func:`agglomerative_clusters` of all pairs with a positive cosine, from the vectors (of length 1, weights not negative) themselves.

    The mean cosine of two clusters is the dot product of their mean vectors, so
    a round looks for the nearest mean of each cluster and shuffles no pairs.
    No merge brings a cluster nearer to others than the nearer of its parts was:
    a cluster without another within the threshold is final and leaves the rounds.
    What is left is merged in one task once it has at most ``LOCAL`` entries.
    Copies of a vector, at distance 0, are merged before the rounds.
    ``vectors`` is read twice: give a table that is kept.
    """
    if threshold >= 1:
        raise ValueError("threshold must be below 1: pairs without a common feature are not listed")
    least = round(1 - threshold, DIGITS)
    packed, levels = allpairs.by_frequency(vectors, id_col, key)
    rounded = F.transform("val", lambda x: F.round(x, 9))
    alone = F.when(F.round(dot(F.col("val"), F.col("val")), DIGITS) < 1, F.col("id"))  # features no other row has part these
    keyed = packed.select("id", F.struct(F.xxhash64("idx", rounded), F.hash("idx", rounded), F.size("idx"), alone).alias("h"))
    groups = materialise(keyed.groupBy("h").agg(F.min("id").alias("c"), F.count("*").cast("double").alias("n")).where(F.col("n") > (1 if threshold >= 0 else float("inf"))))
    copies = materialise(keyed.join(groups, "h").select("id", "c"))
    ids = nodes.select(F.col(id_col).cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    members = materialise(ids.join(copies, "id", "left").select("id", F.coalesce("c", "id").alias("c")))
    first = packed.join(copies.where("id <> c").select("id"), "id", "left_anti").withColumnRenamed("id", "c").join(groups.select("c", "n"), "c", "left")
    n = F.coalesce("n", F.lit(1.0))
    live = materialise(first.select("c", n.alias("n"), F.when(n > 1, 0.0).alias("d"), "idx", F.transform("val", lambda x: x * n).alias("val")))
    final = []
    while (live.agg(F.sum(F.size("idx"))).first()[0] or 0) > LOCAL:
        # the nearest, ties to the smaller id
        means = live.select((-F.col("c")).alias("id"), "idx", F.transform("val", lambda x: x / F.col("n")).alias("val"))
        near = materialise(allpairs.nearest(means, levels, 1, least, DIGITS).select((-F.col("doc_id")).alias("x"), (-F.col("neighbor_id")).alias("y"), F.round(1.0 - F.col("similarity"), DIGITS).alias("d")))
        merges = materialise(near.where("x < y").join(near.select(F.col("x").alias("y"), F.col("y").alias("x")), ["x", "y"]).select(F.col("y").alias("c"), F.col("x").alias("into"), "d"))
        final.append(materialise(live.join(near.select(F.col("x").alias("c")), "c", "left_anti").where("d IS NOT NULL").select("c", "d")))
        move = materialise(merges.unionByName(merges.select(F.col("into").alias("c"), "into", "d")))
        kept = live.join(near.select(F.col("x").alias("c")), "c", "left_semi").join(move.select("c"), "c", "left_anti")
        parts = live.drop("d").join(move, "c")
        sizes = parts.groupBy("into").agg(F.sum("n").alias("n"), F.max("d").alias("d"))
        entries = parts.select("into", F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy("into", "e.idx").agg(F.sum("e.val").alias("val"))
        sums = entries.groupBy("into").agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("p"))
        grown = sizes.join(sums, "into").select(F.col("into").alias("c"), "n", "d", F.transform("p", lambda x: x["idx"]).alias("idx"), F.transform("p", lambda x: x["val"]).alias("val"))
        following = materialise(kept.unionByName(grown)), materialise(members.join(move.select("c", "into"), "c", "left").select("id", F.coalesce("into", "c").alias("c")))
        for old in (live, members, near, merges, move):
            discard(old)
        live, members = following

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], schema)]).sort_by("c").combine_chunks()
        c, n, d, idx, val = (got.column(x).combine_chunks() for x in ("c", "n", "d", "idx", "val"))
        ptr = np.append(0, np.cumsum(np.diff(idx.offsets.to_numpy()))).astype(np.int64)
        root, last = _merged(n.to_numpy().copy(), d.fill_null(np.nan).to_numpy(zero_copy_only=False).copy(), ptr, idx.flatten().to_numpy(), val.flatten().to_numpy(zero_copy_only=False), levels, least)
        yield pa.RecordBatch.from_arrays([c, c.take(pa.array(root)), pa.array(last, mask=np.isnan(last))], ["c", "root", "d"])

    schema = pa.schema([("c", pa.int64()), ("n", pa.float64()), ("d", pa.float64()), ("idx", pa.list_(pa.int32())), ("val", pa.list_(pa.float64()))])
    rest = materialise(live.select("c", "n", "d", F.col("idx").cast("array<int>"), "val").coalesce(1).mapInArrow(run, "c bigint, root bigint, d double"))
    members = members.join(rest.select("c", "root"), "c", "left").select("id", F.coalesce("root", "c").alias("c"))
    last = rest.where("c = root AND d IS NOT NULL").select("c", "d")
    for x in final:
        last = last.unionByName(x)
    order = members.select("c").distinct().join(last, "c", "left").select("c", F.struct(F.col("d").isNotNull().alias("merged"), F.coalesce("d", F.lit(-1.0)).alias("d"), "c").alias("o"))
    return members.join(dense_numbers(order, "o", "cluster_id").select("c", "cluster_id"), "c").select(F.col("id").alias(id_col), "cluster_id")


def _merged(n: np.ndarray, d: np.ndarray, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, levels: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster, in the order of their ids, the one it ends in and the distance of that one's last merge (nan: none).

    Only clusters that merged, or whose nearest did, look for their nearest again.
    """
    size = len(n)
    into, near, best = np.arange(size), np.full(size, -1), np.full(size, -1.0)
    alive, again = np.ones(size, bool), np.ones(size, bool)
    while again.any():
        blocks = _mean_blocks(np.flatnonzero(alive), n, ptr, idx, val, levels)
        for x in _mean_blocks(np.flatnonzero(again), n, ptr, idx, val, levels):
            near[x.ids], best[x.ids] = _nearest_mean(x, blocks, least)
        alive &= near >= 0
        at = np.flatnonzero(alive)
        low = at[(near[near[at]] == at) & (at < near[at])]
        high = near[low]
        into[high], alive[high] = low, False
        n[low] += n[high]
        d[low] = np.round(1 - best[low], DIGITS)
        row = into[np.repeat(np.arange(size), np.diff(ptr))]
        row, idx, val = row[alive[row]], idx[alive[row]], val[alive[row]]
        order = np.lexsort((idx, row))
        row, idx, val = row[order], idx[order], val[order]
        begins = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(idx, prepend=-1) != 0))
        row, idx, val = row[begins], idx[begins], np.add.reduceat(val, begins) if len(begins) else val
        ptr = np.append(0, np.cumsum(np.bincount(row, minlength=size)))
        changed = np.zeros(size, bool)
        changed[low] = changed[high] = True
        again = alive & (changed | changed[near])
    while (into[into] != into).any():
        into = into[into]
    return into, d[into]


def _mean_blocks(rows: np.ndarray, n: np.ndarray, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, levels: np.ndarray) -> list[allpairs.Block]:
    """The mean vectors of some clusters, those of like rare features together."""
    rows = rows[np.diff(ptr)[rows] > 0]
    rows = rows[np.argsort(idx[ptr[rows]], kind="stable")]
    out = []
    for lo in range(0, len(rows), 4 * allpairs.ROWS):
        part = rows[lo : lo + 4 * allpairs.ROWS]
        lens = np.diff(ptr)[part]
        e = allpairs._ranges(ptr[part], lens)
        out.append(allpairs.Block(part, np.append(0, np.cumsum(lens)), idx[e], val[e] / np.repeat(n[part], lens), levels))
    return out


def _nearest_mean(x: allpairs.Block, blocks: list[allpairs.Block], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, its similarity) of each row of ``x`` among the blocks' other rows, -1 where none reaches ``least``; ties to the smaller."""
    near, best = np.full(len(x.ids), -1), np.full(len(x.ids), -1.0)
    for y in blocks:
        for a, b, s in allpairs.products(x, y, np.maximum(least, best - 10.0**-DIGITS)):
            b, s = y.ids[b], np.round(s, DIGITS)
            keep = (x.ids[a] != b) & (s >= least)
            a, b, s, _ = allpairs._firsts(a[keep], -b[keep], s[keep], 1, DIGITS)
            better = (s > best[a]) | ((s == best[a]) & (-b < near[a]))
            near[a[better]], best[a[better]] = -b[better], s[better]
    return near, best
