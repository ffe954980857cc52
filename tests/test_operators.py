"""Vectors, graphs and clusterings against plain Python on small fixtures."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from lexigrain import sums
from lexigrain.functions import ngrams as N
from lexigrain.functions import text as X
from lexigrain.operators import agglomerative, allpairs, classify, graph, leader, metrics, minibatch, packed, report, similarity, spherical, tfidf
from lexigrain.plans import pipelines
from lexigrain.sources import corpora, csvfiles
from lexigrain.streaming.classify import predict_stream
from pyspark.sql import functions as F


def _vectors(spark, n=40, d=6, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    m[5] = 0
    m[7] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, v array<double>")
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return packed.pack_dense(df, "id", "v"), m / np.where(norm > 0, norm, 1)


def test_cosine_of_arrays(spark):
    rows = [([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0, 3.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(similarity.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, 5 / math.sqrt(14 * 5)])


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((1, 0), (30, 10), (60, 70)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        chain = [(100 + i, 101 + i) for i in range(40)]
        nodes = [(i,) for i in [*range(n), *range(100, 141), None, 0]]
        parent = {i[0]: i[0] for i in nodes}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges + chain:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        roots = {x: find(x) for x in parent if x is not None}
        number = {r: i for i, r in enumerate(sorted(set(roots.values())))}
        e = graph.symmetric_edges(spark.createDataFrame(edges + chain, "doc_id bigint, neighbor_id bigint"))
        got = {r["doc_id"]: r["cluster_id"] for r in graph.connected_components(e, spark.createDataFrame(nodes, "doc_id bigint")).collect()}
        assert got == {x: number[r] for x, r in roots.items()}


def test_neighbors_prefer_the_larger_id(spark):
    v = spark.createDataFrame([(i, "f", 1.0) for i in range(4)], "doc_id bigint, feature string, w double")
    got = {(r["doc_id"], r["rank"]): r["neighbor_id"] for r in similarity.top_neighbors(similarity.sparse_pairs(v), 2).collect()}
    assert got[0, 1] == 3 and got[0, 2] == 2 and got[3, 1] == 2 and len(got) == 8
    assert similarity.sparse_pairs(v.limit(0)).count() == 0


def test_copies_have_the_lists_that_all_pairs_give(spark):
    rng = np.random.default_rng(2)
    m = rng.random((40, 5)) * (rng.random((40, 5)) < 0.6)
    m[3:25] = m[2]
    m[30:33] = m[29]
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(n > 0, n, 1)
    v = spark.createDataFrame([(i, str(j), float(m[i, j])) for i in range(40) for j in range(5) if m[i, j]], "doc_id bigint, feature string, w double")
    want = similarity.top_neighbors(similarity.sparse_pairs(v)).collect()
    assert sorted(similarity.nearest_texts(v).collect()) == sorted(want)
    assert similarity.nearest_texts(v.limit(0)).count() == 0


def _shuffled_rows(spark, f):
    """What ``f`` gives and how many rows its stages shuffle."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    out = f()
    return out, sum(n for k, n in written().items() if k not in before)


def test_pairs_are_not_shuffled(spark):
    """A feature that all rows share: a row a pair would be 124 750."""
    n = 500
    rows = [(i, f, x) for i in range(n) for f, x in (("all", 0.6), (f"half{i % 2}", 0.48), (f"some{i % 50}", 0.64))]
    v = spark.createDataFrame(rows, "doc_id bigint, feature string, w double")
    got, moved = _shuffled_rows(spark, lambda: similarity.nearest_texts(v).collect())
    assert moved < 20 * len(rows)
    assert len(got) == 4 * n and {r["similarity"] for r in got} == {1.0}
    got, moved = _shuffled_rows(spark, lambda: similarity.sparse_pairs(v, min_similarity=0.5).collect())
    assert moved < 20 * len(rows) and len(got) == 2 * (n // 2) * (n // 2 - 1) // 2


@pytest.mark.parametrize("rows", [16, 1024])
def test_pairs_and_nearest_of_blocks_are_all(spark, monkeypatch, rows):
    monkeypatch.setattr(allpairs, "ROWS", rows)
    rng = np.random.default_rng(5)
    m = rng.standard_normal((200, 60)) * (rng.random((200, 60)) < np.geomspace(0.02, 0.9, 60))
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    v = spark.createDataFrame([(i * 7, j, float(m[i, j])) for i in range(200) for j in range(60) if m[i, j]], "doc_id int, feature int, w double")
    s = m @ m.T
    for least in (1e-9, 0.3, 0.6):
        got = similarity.sparse_pairs(v, min_similarity=least)
        assert got.schema["a"].dataType == v.schema["doc_id"].dataType
        found = {(r["a"], r["b"]): r["similarity"] for r in got.collect()}
        assert found.keys() == {(i * 7, j * 7) for i in range(200) for j in range(i + 1, 200) if round(s[i, j], 12) >= least}
        assert all(abs(x - s[a // 7, b // 7]) < 1e-12 for (a, b), x in found.items())
    want = {(i * 7, k + 1): j * 7 for i in range(200) for k, j in enumerate(sorted((j for j in range(200) if j != i and s[i, j] >= 0.18), key=lambda j: (-round(s[i, j], 6), -j))[:4])}
    assert {(r["doc_id"], r["rank"]): r["neighbor_id"] for r in similarity.nearest_texts(v).collect()} == want


def test_copies_but_for_features_of_their_own(spark):
    """Rows with the same shared features and a feature of their own each: similar by 0.64, and not at all over a higher bound."""
    v = spark.createDataFrame([(i, f, x) for i in range(9) for f, x in (("all", 0.8), (f"own{i}", 0.6))], "doc_id bigint, feature string, w double")
    got = similarity.nearest_texts(v).collect()
    assert sorted(got) == sorted(similarity.top_neighbors(similarity.sparse_pairs(v)).collect()) and {r["similarity"] for r in got} == {0.64}
    assert similarity.nearest_texts(v, min_similarity=0.7).count() == 0


def test_leaders_are_those_of_the_sequential_pass(spark):
    p, m = _vectors(spark, 60)
    s = np.round(m @ m.T, 6)
    t = 0.35
    leaders, labels = [], []
    for i in range(len(m)):
        best = max(leaders, key=lambda j: (s[i, j], -j), default=None)
        if best is not None and s[i, best] >= t:
            labels.append(leaders.index(best))
        else:
            leaders.append(i)
            labels.append(len(leaders) - 1)
    pairs = [(i, j, float(s[i, j])) for i in range(len(m)) for j in range(i + 1, len(m)) if s[i, j] >= t]
    df = spark.createDataFrame(pairs, "a bigint, b bigint, similarity double")
    got = {r["doc_id"]: r["cluster_id"] for r in leader.leader_clustering(df, spark.range(len(m)).withColumnRenamed("id", "doc_id")).collect()}
    assert [got[i] for i in range(len(m))] == labels
    assert leader.leader_clustering(df.limit(0), spark.range(3).withColumnRenamed("id", "doc_id")).count() == 3


def _average_linkage(s, threshold):
    clusters = [[i] for i in range(len(s))]
    while len(clusters) > 1:
        d, i, j = min((round(1 - np.mean([s[a, b] for a in clusters[i] for b in clusters[j]]), 12), i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters)))
        if d > threshold:
            break
        merged = clusters[i] + clusters[j]
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [merged]
    return clusters


def test_average_linkage(spark):
    rng = np.random.default_rng(4)
    m = np.abs(rng.normal(size=(25, 8)))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    pairs = [(i, j, float(s[i, j])) for i in range(25) for j in range(i + 1, 25)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint, similarity double")
    for t in (0.15, 0.3):
        want = {frozenset(c): k for k, c in enumerate(_average_linkage(s, t))}
        got = defaultdict(set)
        for r in agglomerative.agglomerative_clusters(df, spark.range(25).withColumnRenamed("id", "doc_id"), t).collect():
            got[r["cluster_id"]].add(r["doc_id"])
        assert {frozenset(v) for v in got.values()} == set(want)
        singles = [k for k, v in sorted(got.items()) if len(v) == 1]
        assert singles == list(range(len(singles)))
    with pytest.raises(ValueError):
        agglomerative.agglomerative_clusters(df, spark.range(2).withColumnRenamed("id", "doc_id"), 1.0)


@pytest.mark.parametrize("local", [0, agglomerative.LOCAL])
def test_average_linkage_of_vectors_lists_no_pairs(spark, monkeypatch, local):
    rng = np.random.default_rng(11)
    rows = [(i, {int(f): float(rng.integers(1, 9)) for f in rng.choice(14, rng.integers(1, 5), replace=False)}) for i in range(24)]
    rows += [(60 + i, rows[3 + i % 2][1]) for i in range(4)]  # copies
    rows += [(70 + i, {0: 3.0, 1: 4.0, 100 + i: 2.0}) for i in range(3)]  # copies but for what no other row has
    unit = [(i, f, w / math.sqrt(sum(x * x for x in v.values()))) for i, v in rows for f, w in v.items()]
    df = spark.createDataFrame(unit, "doc_id bigint, feature int, w double").coalesce(1).cache()
    nodes = spark.createDataFrame([(i,) for i, _ in rows] + [(90,), (None,), (3,)], "doc_id bigint")
    want = agglomerative.agglomerative_clusters(similarity.sparse_pairs(df, min_similarity=1e-9), nodes, 0.65).collect()
    monkeypatch.setattr(agglomerative, "LOCAL", local)
    monkeypatch.setattr(allpairs, "pairs", None)
    assert sorted(agglomerative.average_linkage(df, nodes, 0.65).collect()) == sorted(want)
    with pytest.raises(ValueError):
        agglomerative.average_linkage(df, nodes, 1.0)


def test_average_linkage_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, feature string, w double")
    assert agglomerative.average_linkage(df, df.select("doc_id")).count() == 0


def _plain_kmeans(m, ids, rounds):
    c, labels = m[ids].copy(), None
    for _ in range(rounds):
        new = np.round(m @ c.T, 12).argmax(1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        for k in range(len(c)):
            if (labels == k).any():
                v = m[labels == k].sum(0)
                c[k] = v / (np.linalg.norm(v) or 1)
    return labels, c


def test_spherical_kmeans_from_given_seeds(spark):
    p, m = _vectors(spark, 80)
    want, c = _plain_kmeans(m, [0, 1, 2, 4], 50)
    got = spherical.spherical_kmeans(p, 4, 50, init="given", first_ids=[0, 1, 2, 4])
    labels = {r["id"]: r["cluster_id"] for r in got.assignments.collect()}
    assert [labels[i] for i in range(80)] == list(want)
    assert got.score == pytest.approx(sum(m[i] @ c[want[i]] for i in range(80)), abs=1e-4)
    assert sum(got.sizes) == 80


def test_farthest_first(spark):
    p, m = _vectors(spark, 50)
    chosen = [11]
    while len(chosen) < 5:
        gap = np.round(1 - (m @ m[chosen].T).max(1), 12)
        gap[chosen] = -1
        chosen.append(int(gap.argmax()))
    ids, have = spherical.farthest_first(p, 5, [11, 11], 6)
    assert ids == [chosen, chosen] and np.allclose(have[0], m[chosen])


def test_empty_clusters_are_repaired(spark):
    rows = [(i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(8)]
    p = packed.pack_dense(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v")
    got = spherical.spherical_kmeans(p, 3, 10, init="given", first_ids=[0, 1, 5])
    assert min(got.sizes) >= 1 and sum(got.sizes) == 8
    with pytest.raises(ValueError):
        spherical.spherical_kmeans(p, 9)
    with pytest.raises(ValueError):
        spherical.spherical_kmeans(p, 0)
    got = spherical.spherical_kmeans(p, 2, 10, n_init=2, init="random", repair=False)
    assert sum(got.sizes) == 8
    assert spherical.make_clusters(spark, got.assignments, 4).select("cluster_id").distinct().count() == 4


def test_all_zero_vectors_fall_to_cluster_0(spark):
    p = packed.pack_dense(spark.createDataFrame([(i, [0.0, 0.0]) for i in range(6)], "id bigint, v array<double>"), "id", "v")
    got = spherical.spherical_kmeans(p, 3, 5, init="random", repair=False, n_init=1)
    assert got.sizes == (6, 0, 0) and got.score == 0
    repaired = spherical.spherical_kmeans(p, 3, 5, n_init=1)
    assert sorted(repaired.sizes) == [1, 1, 4]


@pytest.mark.parametrize("decay", [False, True])
def test_minibatch(spark, decay):
    """Against the plain loop over batches drawn by the same hash."""
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(90, 6)) * (rng.random((90, 6)) < 0.5), 3)
    long = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(90) for j in range(6) if m[i, j]], "doc_id bigint, feature_id int, w double")
    p = packed.pack(long, spark.range(90).withColumnRenamed("id", "doc_id"))
    draw = lambda it, n: sorted(range(90), key=lambda i: (hashlib.md5(f"42:{it}:{i}".encode()).hexdigest()[:12], i))[:n]
    c, counts = m[draw(0, 4)].copy(), np.zeros(4)
    for it in range(1, 6):
        for i in draw(it, 20):
            best = int(np.round(c @ m[i], 12).argmax())
            counts[best] += 1
            eta, has = 1 / counts[best], m[i] != 0
            c[best] = np.where(has | decay, (1 - eta) * c[best] + eta * m[i], c[best])
    labels, cent = minibatch.minibatch_kmeans(p.repartition(7), 4, 20, 5, decay_absent=decay)
    got = {r["id"]: r["cluster_id"] for r in labels.collect()}
    assert [got[i] for i in range(90)] == list(np.round(m @ c.T, 12).argmax(1))
    assert all(r["w"] == pytest.approx(c[r["cluster_id"], r["feature_id"]]) for r in cent.collect())
    with pytest.raises(ValueError):
        minibatch.minibatch_kmeans(p, 91)


def test_classifier_learns_the_topics(spark):
    e = pipelines.train_and_evaluate(corpora.labelled_topics(spark, 40))
    t = e.totals.first()
    assert t["accuracy"] > 0.9 and t["n"] == 96
    assert e.model.typical("оплата", 5).count() == 5
    with pytest.raises(ValueError):
        e.model.typical("нет такой")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12345"), (4, "zzz")], "doc_id bigint, text string")
    first = e.model.classes.orderBy("label").first()["label"]
    assert {r["prediction"] for r in e.model.predict(odd).collect()} == {first}
    batch = {r["doc_id"]: r["prediction"] for r in e.predictions.collect()}
    test = metrics.stratified_split(corpora.labelled_topics(spark, 40)).where("split = 'test'")
    assert {r["doc_id"]: r["prediction"] for r in predict_stream(e.model, test).collect()} == batch


def test_classifier_errors(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id bigint, text string, label string")
    with pytest.raises(ValueError):
        classify.fit(df)
    with pytest.raises(ValueError):
        classify.fit(df.limit(0))


def test_streaming_classification(spark, tmp_path):
    topics = corpora.labelled_topics(spark, 20)
    model = classify.fit(topics)
    topics.select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    q = predict_stream(model, stream).writeStream.format("memory").queryName("predicted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["doc_id"]: r["prediction"] for r in spark.table("predicted").collect()}
    assert got == {r["doc_id"]: r["prediction"] for r in model.predict(topics).collect()}


def test_report(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    got = {r["label"]: r for r in metrics.report(df).collect()}
    assert got["a"]["precision"] == 0.5 and got["a"]["recall"] == 0.5 and got["c"]["f1"] == 0 and got["c"]["support"] == 1
    s = metrics.summary(df).first()
    assert s["accuracy"] == 0.5 and s["n"] == 4
    assert metrics.summary(df.limit(0)).first()["accuracy"] == 0 and metrics.report(df.limit(0)).count() == 0


def test_split_takes_single_rows_to_the_test_side(spark):
    df = spark.createDataFrame([(i, "a") for i in range(20)] + [(99, "b")], "doc_id bigint, label string")
    n = Counter((r["label"], r["split"]) for r in metrics.stratified_split(df).collect())
    assert n == {("a", "test"): 4, ("a", "train"): 16, ("b", "test"): 1}


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "кот кот пёс"), (2, "пёс"), (3, None), (4, "")], "doc_id bigint, text string")
    bags = tfidf.bag(df.select("doc_id", X.word_tokens("text").alias("t")), "doc_id", F.col("t"))
    got = {(r["doc_id"], r["feature"]): r["w"] for r in tfidf.tfidf(bags, tfidf.vocabulary(bags, 4), "doc_id").collect()}
    idf = lambda k: math.log(5 / (k + 1)) + 1
    assert got == pytest.approx({(1, "кот"): 2 / 3 * idf(1), (1, "пёс"): 1 / 3 * idf(2), (2, "пёс"): idf(2)})
    with pytest.raises(ValueError):
        tfidf.tfidf(bags, tfidf.vocabulary(bags, 4), "doc_id", "sqrt")


def test_graph_pipeline_on_the_tickets(spark):
    r = pipelines.graph_clustering(corpora.tickets(spark))
    assert r.clusters.count() == 24 and r.neighbors.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4
    edges = {(x["src"], x["dst"]) for x in r.graph.collect()}
    assert edges and all((b, a) in edges and a != b for a, b in edges)


def test_csv_files(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('h1,h2,h3\n" a, b ",c,d,extra\n\n"x\ny"\n"q ""q""",\n', encoding="utf-8")
    rows = [tuple(r)[1:] for r in csvfiles.load_csv(spark, str(p)).orderBy("row_id").collect()]
    assert rows == [("a, b", "c", "d"), ("x\ny", "", ""), ('q "q"', "", "")]
    assert csvfiles.load_csv(spark, str(p), has_header=False).count() == 4
    labels, _, _ = pipelines.csv_clustering(spark, str(p), str(tmp_path / "out"), k=2, batch_size=3, iterations=2, min_df=1)
    assert labels.count() == 3
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out")).columns == ["col1", "col2", "col3", "cluster_id"]


def test_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("а\nб\nв\n")
    (tmp_path / "l.txt").write_text("x\ny\nz\n")
    got = csvfiles.load_lines(spark, str(tmp_path / "t.txt"), str(tmp_path / "l.txt")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, "а", "x"), (1, "б", "y"), (2, "в", "z")]


def test_histogram(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(11)] + [(None,)], "similarity double")
    got = [r["n"] for r in report.similarity_histogram(df, 5).orderBy("bin").collect()]
    assert sum(got) == 11 and got[-1] == 3
    assert report.similarity_histogram(df.limit(0)).count() == 0
    assert sum(r["n"] for r in report.similarity_histogram(df.where("similarity = 0.5")).collect()) == 1


def test_ngrams_of_generated_topics_do_not_depend_on_partitions(spark):
    a = corpora.labelled_topics(spark, 10).orderBy("doc_id").collect()
    b = corpora.labelled_topics(spark, 10).repartition(5).orderBy("doc_id").collect()
    assert a == b and len(a) == 120
    assert corpora.template_tickets(spark, 7).count() == 7
    assert N.word_ngrams is not None


def test_kmeans_passes_take_each_open_run_once(spark, monkeypatch):
    p, _ = _vectors(spark, n=60)
    want = spherical.spherical_kmeans(p, 4, n_init=5)
    passes, summed = [], spherical.summed

    def watched(df, add, size):
        free = dict(zip(add.__code__.co_freevars, (c.cell_contents for c in add.__closure__)))
        passes.append((len(free["sent"].value), size))
        return summed(df, add, size)

    monkeypatch.setattr(spherical, "summed", watched)
    monkeypatch.setattr(spherical, "PASS", 2 * 4 * 6, raising=False)
    monkeypatch.setattr(sums, "LARGE", 0, raising=False)
    got = spherical.spherical_kmeans(p, 4, n_init=5)
    assert max(size for _, size in passes) == 2 * (4 * 6 + 4 + 3)
    assert max(n for n, size in passes if size > 2 * (4 + 1)) == 2 * 4
    assert (got.score, got.sizes, got.iterations) == (want.score, want.sizes, want.iterations)
    assert sorted(got.assignments.collect()) == sorted(want.assignments.collect())


@pytest.mark.parametrize("held, iterations", [(-1, 100), (0, 100), (10**9, 2), (-1, 1)])
def test_kmeans_runs_in_a_task_each_are_those_in_passes(spark, monkeypatch, held, iterations):
    """With copies, rows of zeros and more clusters than directions, so that clusters are empty and repaired."""
    from lexigrain.operators import wholeruns

    rng = np.random.default_rng(3)
    m = np.repeat(rng.random((40, 30)) * (rng.random((40, 30)) < 0.3), 2, axis=0)
    m[7] = 0
    for rows, k in ((m, 5), (m[:12], 9)):
        p = spark.createDataFrame([(100 - i, [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[x != 0]]) for i, x in enumerate(rows)], "id bigint, idx array<int>, val array<double>").repartition(3, "id")
        monkeypatch.setattr(wholeruns, "SENT", 10**9)
        want = spherical.spherical_kmeans(p, k, iterations, n_init=6)
        monkeypatch.setattr(wholeruns, "SENT", 0)
        monkeypatch.setattr(wholeruns, "HELD", abs(held))
        monkeypatch.setattr(wholeruns, "MAPPED", held < 0)
        with monkeypatch.context() as c:
            c.setattr(spherical, "summed", None)  # no passes
            got = spherical.spherical_kmeans(p, k, iterations, n_init=6)
        assert (got.score, got.sizes, got.iterations) == (want.score, want.sizes, want.iterations)
        assert sorted(got.assignments.collect()) == sorted(want.assignments.collect())
        assert {(r[0], r[1]): round(r[2], 9) for r in got.centroids.collect()} == {(r[0], r[1]): round(r[2], 9) for r in want.centroids.collect()}
