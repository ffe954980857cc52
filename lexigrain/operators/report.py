"""Tables behind listings and plots: every one a DataFrame, drawing left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cleaned_texts(df: DataFrame, tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, cleaned``: each text beside its tokens joined by spaces."""
    return df.select(id_col, text_col, F.array_join(tokens, " ").alias("cleaned"))


def neighbor_listing(documents: DataFrame, neighbors: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, rank, similarity, neighbor_id, neighbor_text``; a document without neighbours has one row with rank null."""
    texts = documents.select(F.col(id_col).alias("neighbor_id"), F.col(text_col).alias("neighbor_text"))
    n = neighbors.join(texts, "neighbor_id").select(F.col("doc_id").alias(id_col), "rank", F.format_number("similarity", 3).alias("similarity"), "neighbor_id", "neighbor_text")
    return documents.select(id_col, text_col).join(n, id_col, "left")


def cluster_listing(documents: DataFrame, clusters: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``cluster_id, size, id, text``: one row a member, so clusters may be of any size."""
    size = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return clusters.join(size, "cluster_id").join(documents.select(id_col, text_col), id_col).select("cluster_id", "size", id_col, text_col)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))


def size_histogram(clusters: DataFrame) -> DataFrame:
    """``size, n_clusters``: how many clusters have each size."""
    return cluster_sizes(clusters).groupBy("size").agg(F.count("*").alias("n_clusters"))


def top_features(vectors: DataFrame, clusters: DataFrame, top: int = 10, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """``cluster_id, rank, feature, kind, value, score``: the features of largest summed weight, ties to the smaller feature.

    ``kind`` is the first two characters of the feature, ``value`` the rest.
    """
    s = vectors.join(clusters.select(id_col, "cluster_id"), id_col).groupBy("cluster_id", "feature").agg(F.round(F.sum("w"), digits).alias("score"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "feature")
    ranked = s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("cluster_id", "rank", "feature", F.substring("feature", 1, 2).alias("kind"), F.expr("substring(feature, 3)").alias("value"), "score")


def centroid_features(centroids: DataFrame, vocabulary: DataFrame, top: int = 8) -> DataFrame:
    """``cluster_id, rank, tag, value, weight``: the heaviest features of centroids; ``tag`` tells words and letters apart."""
    named = centroids.where("w <> 0").join(vocabulary.select("feature_id", "feature"), "feature_id")
    order = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("w", 9)), "feature")
    tag = F.when(F.col("feature").startswith("w:"), "[Слово]").otherwise("[Буква]")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("cluster_id", "rank", tag.alias("tag"), F.expr("substring(feature, 3)").alias("value"), F.format_number("w", 3).alias("weight"))


def word_listing(words: DataFrame, column: str, empty: str = "-") -> DataFrame:
    """``words``: the distinct values in order, joined by commas, or a mark where there are none (a listing of few words)."""
    joined = F.array_join(F.array_sort(F.collect_set(column)), ", ")
    return words.agg(F.when(F.count(column) > 0, joined).otherwise(F.lit(empty)).alias("words"))


def similarity_histogram(neighbors: DataFrame, bins: int = 20, digits: int = 9) -> DataFrame:
    """``bin, lower, upper, n``: equal bins from the least to the largest similarity, the last one closed; nothing for no neighbours.

    Where all are equal the range is widened by a half to either side.
    """
    s = neighbors.where(F.col("similarity").isNotNull()).select(F.round("similarity", digits).alias("s"))
    ends = s.agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a IS NOT NULL")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    placed = s.join(F.broadcast(ends)).select(F.least(F.floor((F.col("s") - F.col("a")) * bins / (F.col("b") - F.col("a"))), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = (F.col("b") - F.col("a")) / bins
    return grid.join(counts, "bin", "left").select("bin", F.round(F.col("a") + F.col("bin") * step, 6).alias("lower"), F.round(F.col("a") + (F.col("bin") + 1) * step, 6).alias("upper"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def random_projection(vectors: DataFrame, documents: DataFrame, id_col: str = "doc_id", key: str = "feature", seed: int = 42, digits: int = 6) -> DataFrame:
    """``id, x, y``: products with two directions whose entries are hashes of the feature in -1..1.

    The directions need no table: they are computed from the feature (MD5, which
    SQL engines share) where it stands.
    """

    def direction(axis: str):
        h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{axis}:"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double")
        return h / F.lit(float(1 << 48)) * 2 - 1

    xy = vectors.groupBy(id_col).agg(*[F.round(F.sum(F.col("w") * direction(a)), digits).alias(a) for a in ("x", "y")])
    return documents.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(xy, id_col, "left").select(id_col, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def clustering_summary(clusters: DataFrame, score: float, digits: int = 4) -> DataFrame:
    """``clusters, rows, smallest, largest, score``: one row."""
    return cluster_sizes(clusters).agg(F.count("*").alias("clusters"), F.sum("size").alias("rows"), F.min("size").alias("smallest"), F.max("size").alias("largest")).withColumn("score", F.round(F.lit(float(score)), digits))
