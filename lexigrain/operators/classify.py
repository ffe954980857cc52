"""Nearest-centroid classification of texts by TF-IDF of words and characters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ngrams import padded_char_ngrams, word_ngrams
from ..functions.text import classifier_tokens, normalised
from ..scratch import materialise
from .packed import assign, check_matrix, pack
from .tfidf import BROADCAST_VOCABULARY, bag, tfidf, vocabulary


@dataclass(frozen=True)
class ClassifierOptions:
    """Ranges of word and character grams, least document frequency, most features, and which character grams count."""

    word_range: tuple[int, int] = (1, 2)
    char_range: tuple[int, int] = (3, 5)
    min_df: int = 2
    max_features: int = 60_000
    gram_filter: str = "[а-я]"


@dataclass(frozen=True)
class Classifier:
    """A fitted model: ``vocabulary`` (feature, df, idf, feature_id), ``centroids`` (label_id, feature_id, w), ``classes`` (label_id, label, n, norm)."""

    options: ClassifierOptions
    vocabulary: DataFrame
    centroids: DataFrame
    classes: DataFrame

    def transform(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id, feature, feature_id, w``: vectors of length 1; grams outside the vocabulary are ignored."""
        return tfidf(features(df, id_col, text_col, self.options), self.vocabulary, id_col, "log", normalise=True, broadcast=self.options.max_features <= BROADCAST_VOCABULARY)

    def predict(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id, prediction, score`` of every row: the best centroid, ties to the smaller label.

        A text without known features, or that scores 0 everywhere, gets the
        first label.  Null text reads as empty; null ids are left out.
        """
        vectors = pack(self.transform(df, id_col, text_col), df, id_col)
        names = self.classes.select("label_id", F.col("label").alias("prediction"))
        positive = F.col("similarity") > 0
        got = assign(vectors, self.matrix(), unit=False, digits=12)
        got = got.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.when(positive, F.col("cluster_id")).otherwise(0).alias("label_id"), F.when(positive, F.col("similarity")).otherwise(0.0).alias("score"))
        return got.join(names, "label_id").select(id_col, "prediction", F.round("score", 6).alias("score"))

    def matrix(self) -> np.ndarray:
        """The centroids as rows; bounded by labels and vocabulary, and checked."""
        k, w = self.classes.count(), int(self.vocabulary.agg(F.max("feature_id")).first()[0] or 0) + 1
        check_matrix(k, w)
        got, out = self.centroids.toArrow(), np.zeros((k, w))
        out[got.column("label_id").to_numpy(), got.column("feature_id").to_numpy()] = got.column("w").to_numpy()
        return out

    def typical(self, label: str | None = None, top: int = 20) -> DataFrame:
        """``label, rank, feature, w``: the heaviest features of one label or all, ties to the smaller feature."""
        if label is not None and not self.classes.where(F.col("label") == label).limit(1).count():
            raise ValueError(f"unknown label {label!r}")
        classes = self.classes if label is None else self.classes.where(F.col("label") == label)
        named = self.centroids.where("w <> 0").join(classes.select("label_id", "label"), "label_id").join(self.vocabulary.select("feature_id", "feature"), "feature_id")
        order = Window.partitionBy("label").orderBy(F.desc(F.round("w", 9)), "feature")
        return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("label", "rank", "feature", F.round("w", 6).alias("w"))

    def projection(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_points: int = 1500) -> DataFrame:
        """``id, x, y``: cosines to the first two centroids of the first ``max_points`` rows by id (the points of a plot)."""
        points = df.where(F.col(id_col).isNotNull()).select(id_col, text_col).orderBy(id_col).limit(max_points)
        axes = self.centroids.where("label_id < 2")
        v = self.transform(points, id_col, text_col).select(id_col, "feature_id", F.col("w").alias("_w")).join(axes, "feature_id")
        xy = v.groupBy(id_col).agg(*[F.round(F.sum(F.when(F.col("label_id") == i, F.col("_w") * F.col("w")).otherwise(0.0)), 6).alias(n) for i, n in ((0, "x"), (1, "y"))])
        return points.select(id_col).join(xy, id_col, "left").select(id_col, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def features(df: DataFrame, id_col: str, text_col: str, o: ClassifierOptions = ClassifierOptions()) -> DataFrame:
    """``id, feature, tf``: counts of word grams (``w:``) and character grams (``c:``)."""
    clean = df.select(id_col, normalised(text_col).alias("_t")).withColumn("_w", classifier_tokens(F.col("_t")))
    return bag(clean, id_col, F.concat(word_ngrams(F.col("_w"), *o.word_range, "_", "w:"), padded_char_ngrams(F.col("_t"), *o.char_range, o.gram_filter)))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", options: ClassifierOptions = ClassifierOptions()) -> Classifier:
    """Fits on the rows with a label (and an id); raises ValueError for no rows or fewer than two labels.

    A class centroid is the sum of its unit vectors over the number of its
    documents, also those without features, then brought to length 1; ``norm``
    keeps the length before.  The model's tables are bounded by the vocabulary
    and the labels and are kept for reuse.
    """
    rows = df.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col, F.col(label_col).alias("label"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    found = counts.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if not found["n"]:
        raise ValueError("no labelled rows")
    if found["k"] < 2:
        raise ValueError("at least two labels are needed")
    bags = features(rows, id_col, text_col, options).persist()
    vocab = materialise(vocabulary(bags, found["n"], options.min_df, options.max_features))
    vectors = tfidf(bags, vocab, id_col, "log", normalise=True, broadcast=options.max_features <= BROADCAST_VOCABULARY)
    classes = counts.withColumn("label_id", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))
    total = vectors.join(rows.select(id_col, "label"), id_col).groupBy("label", "feature_id").agg(F.sum("w").alias("w"))
    mean = materialise(total.join(classes, "label").select("label_id", "feature_id", (F.col("w") / F.col("n")).alias("w")))
    bags.unpersist()
    norm = mean.groupBy("label_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    centroids = mean.join(norm, "label_id").select("label_id", "feature_id", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(F.col("w")).alias("w"))
    classes = classes.join(norm, "label_id", "left").select("label_id", "label", "n", F.coalesce("norm", F.lit(0.0)).alias("norm"))
    return Classifier(options, vocab, materialise(centroids), materialise(classes))
