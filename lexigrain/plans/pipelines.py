"""Whole analyses: graph clustering, CSV clustering, classification with evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ngrams import char_ngrams, ticket_ngrams, word_ngrams
from ..functions.text import clean_tokens, stemmed_tokens
from ..operators.classify import Classifier, ClassifierOptions, fit
from ..operators.graph import connected_components, symmetric_edges
from ..operators.metrics import report, stratified_split, summary
from ..operators.minibatch import minibatch_kmeans
from ..operators.packed import pack
from ..operators.similarity import nearest_texts
from ..operators.tfidf import bag, document_frequency, frequent_words, pruned_tfidf, tfidf, vocabulary, weighted_bag
from ..scratch import materialise
from ..sources.csvfiles import joined_text, load_csv, save_clustered


@dataclass(frozen=True)
class GraphOptions:
    """Neighbours, threshold, share above which a word is common, ranges and weights of word and character grams."""

    k: int = 4
    min_similarity: float = 0.18
    max_share: float = 0.85
    word_range: tuple[int, int] = (1, 2)
    char_range: tuple[int, int] | None = (3, 5)
    word_weight: float = 1.0
    char_weight: float = 1.2
    max_df: int | None = None


@dataclass(frozen=True)
class GraphResult:
    """What each step of the graph clustering gives."""

    tokens: DataFrame
    common_words: DataFrame
    document_frequency: DataFrame
    vectors: DataFrame
    feature_df: DataFrame
    neighbors: DataFrame
    graph: DataFrame
    clusters: DataFrame


def without_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id, tokens`` without the ``word`` rows of ``words``, in their order; a text that loses all has an empty list.

    An anti-join of the exploded tokens rather than a list that grows with the vocabulary.
    """
    placed = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "word")).join(words.select("word"), "word", "left_anti")
    kept = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("t")).select("doc_id", F.transform("t", lambda x: x["word"]).alias("kept"))
    return tokens.select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("kept", F.array().cast("array<string>")).alias("tokens"))


def graph_clustering(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: GraphOptions = GraphOptions()) -> GraphResult:
    """Clean, drop common words, weigh grams, find neighbours, link them, take components."""
    o = options
    n = df.where(F.col(id_col).isNotNull()).count()
    tokens = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), clean_tokens(text_col).alias("tokens"))
    bags = bag(tokens, "doc_id", F.col("tokens"))
    words = document_frequency(bags).withColumnRenamed("feature", "word")
    common = frequent_words(bags, n, o.max_share).select(F.col("feature").alias("word"), "df")
    kept = without_words(tokens, common)
    parts = [(word_ngrams(F.col("tokens"), *o.word_range, " ", "W:"), o.word_weight)]
    if o.char_range:
        parts.append((char_ngrams(F.array_join("tokens", " "), *o.char_range, "C:"), o.char_weight))
    weighted = weighted_bag(kept, "doc_id", parts)
    features = vocabulary(weighted, n)
    vectors = materialise(tfidf(weighted, features, "doc_id", "raw", normalise=True))
    neighbors = materialise(nearest_texts(vectors, "doc_id", "feature", o.min_similarity, o.k, max_df=o.max_df))
    graph = symmetric_edges(neighbors)
    clusters = connected_components(graph, tokens)
    return GraphResult(tokens, common, words, vectors, features, neighbors, graph, clusters)


def ticket_vectors(df: DataFrame, id_col: str, min_df: int = 3, max_features: int = 5000, columns: tuple[str, ...] = ("col1", "col2", "col3")) -> tuple[DataFrame, DataFrame]:
    """(vectors, vocabulary) of rows read as one text of three columns: stems, word and character grams, pruned."""
    text = df.where(F.col(id_col).isNotNull()).select(id_col, stemmed_tokens(joined_text(*columns)).alias("stems"))
    return pruned_tfidf(bag(text, id_col, ticket_ngrams(F.col("stems"))), text.count(), id_col, min_df, max_features)


def csv_clustering(spark: SparkSession, path: str, out: str, k: int = 10, batch_size: int = 2000, iterations: int = 20, min_df: int = 3, max_features: int = 5000, has_header: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reads a CSV file, clusters its rows by mini-batch k-means, writes them with their cluster; (labels, centroids, vocabulary)."""
    rows = materialise(load_csv(spark, path, has_header))
    vectors, vocab = ticket_vectors(rows, "row_id", min_df, max_features)
    vocab = materialise(vocab)
    labels, centroids = minibatch_kmeans(materialise(pack(vectors, rows, "row_id")), k, batch_size, iterations)
    labels = labels.withColumnRenamed("id", "row_id")
    save_clustered(rows, labels, out)
    return labels, centroids, vocab


@dataclass(frozen=True)
class Evaluation:
    """A fitted classifier, its predictions for the test rows, the report by label and the totals."""

    model: Classifier
    predictions: DataFrame
    by_label: DataFrame
    totals: DataFrame


def train_and_evaluate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", test_ratio: float = 0.2, seed: int = 42, options: ClassifierOptions = ClassifierOptions()) -> Evaluation:
    """Splits by label, fits on the training side, predicts and reports the test side."""
    split = stratified_split(df.where(F.col(label_col).isNotNull()), label_col, id_col, test_ratio, seed)
    model = fit(split.where("split = 'train'"), id_col, text_col, label_col, options)
    test = split.where("split = 'test'")
    predictions = model.predict(test, id_col, text_col).join(test.select(id_col, F.col(label_col).alias("label")), id_col)
    return Evaluation(model, predictions, report(predictions), summary(predictions))
