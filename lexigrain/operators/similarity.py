"""Cosines of dense and sparse vectors, nearest neighbours, nearest centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from . import allpairs


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, over the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a length is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def normalised(a: Column) -> Column:
    """The array with length 1; an array of zeros stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def sparse_norms(vectors: DataFrame, id_col: str, w: str = "w") -> DataFrame:
    return vectors.groupBy(id_col).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias("norm"))


def sparse_pairs(vectors: DataFrame, id_col: str = "doc_id", key: str = "feature", min_similarity: float = 0.18, max_df: int | None = None) -> DataFrame:
    """``a, b, similarity`` with a < b: dot products of vectors of length 1 that share a feature; ids are integers.

    Pairs under ``min_similarity`` (positive; compared after rounding to 12 digits, so the
    order of summation does not matter) are left out.  No pair is shuffled (see :mod:`.allpairs`), but the
    work grows with the pairs of rows; ``max_df`` leaves out features in more documents (not exact; None: all features).
    """
    kind = vectors.schema[id_col].dataType
    found = allpairs.pairs(*allpairs.by_frequency(vectors, id_col, key, max_df), min_similarity)
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "similarity")


def top_neighbors(pairs: DataFrame, k: int = 4, digits: int = 6) -> DataFrame:
    """``doc_id, neighbor_id, similarity, rank``: the k best of each side of the pairs.

    Similarities are rounded to ``digits``; ties go to the larger neighbour id.
    """
    both = pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("neighbor_id"), F.round("similarity", digits).alias("similarity"))
    both = both.unionByName(both.select(F.col("neighbor_id").alias("doc_id"), F.col("doc_id").alias("neighbor_id"), "similarity"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("similarity"), F.desc("neighbor_id"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_texts(vectors: DataFrame, id_col: str = "doc_id", key: str = "feature", min_similarity: float = 0.18, k: int = 4, digits: int = 6, max_df: int | None = None) -> DataFrame:
    """``doc_id, neighbor_id, similarity, rank``: the ``k`` most similar others of every vector of length 1, as :func:`top_neighbors` of :func:`sparse_pairs`.

    Of more than ``k + 1`` copies of a vector (but for features no other row has)
    only the ``k + 1`` of largest id are compared: no other can be in a list, as
    ties go to the larger id.  The other copies take the largest and its list, so
    a group of copies never becomes all its pairs, whatever share of the rows it
    holds.  ``vectors`` is read twice: give a table that is kept.
    """
    kind = vectors.schema[id_col].dataType
    packed, levels = allpairs.by_frequency(vectors, id_col, key, max_df)
    rounded = F.transform("val", lambda x: F.round(x, 9))
    keyed = packed.select("id", F.struct(F.xxhash64("idx", rounded), F.hash("idx", rounded), F.size("idx")).alias("h"), dot(F.col("val"), F.col("val")).alias("own"))
    large = keyed.groupBy("h").agg(F.count("*").alias("n"), F.max(F.struct("id", "own")).alias("m")).where(F.col("n") > k + 1)
    large = materialise(large.select("h", F.col("m.id").alias("last"), "m.own"))
    if large.limit(1).count():
        # the limit of the rank is taken before the shuffle as well: a task sends k + 1 ids of a group
        place = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("id")))
        members = keyed.drop("own").join(large, "h")
        first = materialise(members.withColumn("place", place).where(F.col("place") <= k + 1).select("id"))
        rest = materialise(members.join(first, "id", "left_anti").select("id", "last"))
        packed = packed.join(rest.select("id"), "id", "left_anti")
    lists = materialise(allpairs.nearest(packed, levels, k, min_similarity, digits).withColumn("similarity", F.round("similarity", digits)))
    if large.limit(1).count():
        own = large.where(F.round("own", 12) >= min_similarity).select(F.col("last").alias("doc_id"), F.col("last").alias("neighbor_id"), F.round("own", digits).alias("similarity"))
        merged = lists.join(large.select(F.col("last").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "neighbor_id", "similarity").unionByName(own)
        order = Window.partitionBy("doc_id").orderBy(F.desc("similarity"), F.desc("neighbor_id"))
        merged = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        followed = rest.join(merged.withColumnRenamed("doc_id", "last"), "last").select(F.col("id").alias("doc_id"), "neighbor_id", "similarity", "rank")
        lists = lists.unionByName(followed)
    return lists.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("neighbor_id").cast(kind).alias("neighbor_id"), "similarity", "rank")
