"""Document frequencies, vocabularies and TF-IDF weightings in long form.

A bag is ``id, feature, tf``; a vector is ``id, feature, w``.  The number of
documents always comes from the table of documents, so texts without features
count.  Weightings are partial aggregations and joins on the feature; norms are
windows over the document, whose features already lie together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import by_id, sorted_merge

#: Beyond this many rows a vocabulary is joined by shuffle; up to it, it is small enough to broadcast.
BROADCAST_VOCABULARY = 200_000


def exploded(df: DataFrame, id_col: str, grams: Column, feature: str = "feature") -> DataFrame:
    """``id, feature``: one row for each gram.  Rows with a null id are left out."""
    return by_id(df.where(F.col(id_col).isNotNull()), id_col).select(id_col, F.explode(grams).alias(feature))


def bag(df: DataFrame, id_col: str, grams: Column) -> DataFrame:
    """``id, feature, tf``: how often each gram occurs in each document."""
    return exploded(df, id_col, grams).groupBy(id_col, "feature").agg(F.count("*").cast("double").alias("tf"))


def weighted_bag(df: DataFrame, id_col: str, parts: list[tuple[Column, float]]) -> DataFrame:
    """As :func:`bag`, each occurrence counting with the weight of its part."""

    def with_weight(grams: Column, w: float) -> Column:
        return F.transform(grams, lambda x: F.struct(x.alias("feature"), F.lit(float(w)).alias("x")))

    weighted = F.concat(*[with_weight(g, w) for g, w in parts])
    rows = by_id(df.where(F.col(id_col).isNotNull()), id_col).select(id_col, F.explode(weighted).alias("g")).select(id_col, "g.feature", "g.x")
    return rows.groupBy(id_col, "feature").agg(F.sum("x").alias("tf"))


def document_frequency(bags: DataFrame) -> DataFrame:
    """``feature, df``: in how many documents each feature occurs; ``bags`` has a feature once a document."""
    return bags.groupBy("feature").agg(F.count("*").alias("df"))


def smooth_idf(df: Column, n_docs: int) -> Column:
    return F.log((F.lit(n_docs) + 1.0) / (df + 1.0)) + 1.0


def vocabulary(bags: DataFrame, n_docs: int, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """``feature, df, idf`` and, with ``max_features``, ``feature_id``.

    Kept are the features in at least ``min_df`` documents; of these the
    ``max_features`` most frequent, ties to the smaller feature.
    """
    v = document_frequency(bags).where(F.col("df") >= min_df)
    if max_features is None:
        return v.withColumn("idf", smooth_idf(F.col("df"), n_docs))
    top = v.orderBy(F.desc("df"), "feature").limit(max_features)
    return top.withColumn("feature_id", (F.row_number().over(Window.orderBy(F.desc("df"), "feature")) - 1).cast("int")).withColumn("idf", smooth_idf(F.col("df"), n_docs))


def frequent_words(bags: DataFrame, n_docs: int, max_share: float = 0.85) -> DataFrame:
    """``feature, df`` of features in more than ``max_share`` of all documents."""
    return document_frequency(bags).where(F.col("df") / F.lit(float(max(n_docs, 1))) > max_share)


def unit(vectors: DataFrame, id_col: str, w: str = "w") -> DataFrame:
    """Vectors of length 1; a vector of zeros stays as it is."""
    norm = F.sqrt(F.sum(F.col(w) * F.col(w)).over(Window.partitionBy(id_col)))
    return vectors.withColumn("_n", norm).withColumn(w, F.when(F.col("_n") > 0, F.col(w) / F.col("_n")).otherwise(F.col(w))).drop("_n")


def tfidf(bags: DataFrame, vocab: DataFrame, id_col: str, tf: str = "share", normalise: bool = False, broadcast: bool = False) -> DataFrame:
    """``id, feature, w`` (and ``feature_id`` where the vocabulary has one).

    ``tf`` is ``share`` (count over all grams of the document, also those outside
    the vocabulary), ``raw`` (the bag's own weight) or ``log`` (1 + ln count).
    """
    if tf == "share":
        bags = bags.withColumn("tf", F.col("tf") / F.sum("tf").over(Window.partitionBy(id_col)))
    elif tf == "log":
        bags = bags.withColumn("tf", 1.0 + F.log("tf"))
    elif tf != "raw":
        raise ValueError(f"unknown tf {tf!r}")
    joined = bags.join(F.broadcast(vocab) if broadcast else sorted_merge(vocab), "feature")
    ids = ["feature_id"] if "feature_id" in vocab.columns else []
    out = joined.select(id_col, "feature", *ids, (F.col("tf") * F.col("idf")).alias("w"))
    return unit(out, id_col) if normalise else out


def pruned_tfidf(bags: DataFrame, n_docs: int, id_col: str, min_df: int, max_features: int, tf: str = "share") -> tuple[DataFrame, DataFrame]:
    """(vectors of length 1, vocabulary) over a bounded vocabulary, which is broadcast while it is small."""
    v = vocabulary(bags, n_docs, min_df, max_features)
    return tfidf(bags, v, id_col, tf, normalise=True, broadcast=max_features <= BROADCAST_VOCABULARY), v
