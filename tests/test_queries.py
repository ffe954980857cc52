"""Registered queries against their SQL on the smallest test tables."""

import os

import pytest
from lexigrain import queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
CHECKED = (
    "p2_found", "p2_loaded", "tokens_words", "tokens_clean", "tokens_stemmed", "tokens_classifier", "text_letters_literal", "text_normalised", "ngrams_word_zero", "ngrams_char", "ngrams_ticket", "features_mixed_spaceless",
    "bag_weighted", "tfidf_share", "tfidf_weighted", "vocabulary_pruned", "without_common_words", "cosine_dense", "neighbors_top4", "graph_components", "cluster_top_features", "similarity_histogram", "random_projection",
    "kmeans_two_rounds", "stratified_split", "classifier_predict", "classifier_typical", "classification_summary", "csv_round_trip",
    "tfidf_mixed", "kmeans_random", "leader_topics", "agglomerative_news", "graph_pipeline", "classifier_projection", "classifier_stream", "lines_round_trip", "labelled_topics",
)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


def _plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    result = duck.execute(Q.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _plain(df.columns, df.collect()) == _plain(columns, result.fetchall())


def test_entry_registers_what_there_is():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(Q.QUERIES) <= set(e.queries())


@pytest.mark.parametrize("name, runs", [("kmeans_random", 10), ("kmeans_farthest", 20), ("kmeans_topics", 20), ("kmeans_summary", 20), ("kmeans_clusters", 20)])
def test_kmeans_presets(spark, monkeypatch, name, runs):
    import inspect

    import __spark_entry__
    from lexigrain.operators import spherical

    signature, seen = inspect.signature(spherical.spherical_kmeans), {}

    class Stop(Exception):
        pass

    def record(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Stop

    monkeypatch.setattr(spherical, "spherical_kmeans", record)
    with pytest.raises(Stop):
        __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert (seen["max_iterations"], seen["n_init"]) == (100, runs)


def test_graph_pipeline_topics_uses_the_production_options(spark, monkeypatch):
    from lexigrain.plans import pipelines

    class Stop(Exception):
        pass

    seen = []

    def record(df, id_col="doc_id", text_col="text", options=pipelines.GraphOptions()):
        seen.append(options)
        raise Stop

    monkeypatch.setattr(pipelines, "graph_clustering", record)
    with pytest.raises(Stop):
        Q.QUERIES["graph_pipeline_topics"](spark, DIR)
    assert seen == [pipelines.GraphOptions()] and seen[0].char_range == (3, 5)


def test_agglomerative_topics_covers_the_table(spark):
    got = Q.QUERIES["agglomerative_topics"](spark, DIR).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{DIR}/topics12.parquet").where("doc_id IS NOT NULL").collect()}
    assert {r["doc_id"] for r in got} == ids and len(got) == len(ids)


def test_tfidf_mixed_broadcasts_no_grams(spark):
    """Spark takes exploded grams for as large as their texts, so it would send them through the driver."""
    plan = Q.QUERIES["tfidf_mixed"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
