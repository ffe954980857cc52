"""Similar vectors, similar rows and mixtures against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from lexigrain.llm import mixture, setjoin, vectors


def _brute(ids, m, k, least):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    out = {}
    for a in range(len(ids)):
        c = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if ids[b] != ids[a] and s[a, b] >= least)[:k]
        out[ids[a]] = [(i, -x) for x, i in c]
    return out


def _data(seed=0, groups=40, size=12, d=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, d))
    m = np.repeat(centre, size, 0) + rng.normal(size=(groups * size, d)) * 0.15
    return (m * rng.uniform(0.1, 9, size=(len(m), 1))).astype(np.float32)


def _table(spark, ids, m, extra=()):
    rows = [(int(i), [float(x) for x in v], 1.0) for i, v in zip(ids, m)] + list(extra)
    return spark.createDataFrame(rows, "row_id bigint, vec array<float>, similarity double")


NEAR = {"min_similarity": 0.9, "tables": vectors.NEAR_TABLES, "probes": vectors.NEAR_PROBES, "probe_ratio": vectors.NEAR_RATIOS}


@pytest.mark.parametrize("near, least, options", [(True, 1, {}), (True, 0.9, {"cell_rows": 8}), (True, 0.9, {"cell_rows": 60, "local_rows": 30}), (True, 0.5, {"cell_rows": 500, "hot_rows": 3}), (False, 0.9, {"cell_rows": 60})])
def test_recall_against_brute_force(spark, near, least, options):
    m = _data()
    ids = np.random.default_rng(1).permutation(len(m)) + 10
    want = _brute(ids, m.astype(float), 10, 0.9 if near else -2)
    got = defaultdict(list)
    for r in vectors.similar_vectors(_table(spark, ids, m), dim=16, **options, **(NEAR if near else {})).orderBy("rank").collect():
        got[r["row_id"]].append((r["neighbor_id"], r["similarity"]))
    pairs = lambda x: {(a, b) for a, v in x.items() for b, _ in v}
    recall = len(pairs(got) & pairs(want)) / len(pairs(want))
    assert recall >= least, recall
    s = {(a, b): x for a, v in want.items() for b, x in v}
    assert all(abs(x - s[a, b]) < 2e-6 for a, v in got.items() for b, x in v if (a, b) in s)


def test_cells_keep_their_size():
    for n in (0, 1, 4096, 10_000, 300_000, 90_000_000, 3 * 10**11):
        axes = vectors.axes_for(n, 64)
        cells = np.prod([2.0 * a for a in axes]) if axes else 1
        assert n / cells <= 8192 < 8 * max(n / cells, 2048) and all(a <= 64 for a in axes)


@pytest.mark.parametrize("max_heads", [50, 0])
def test_copies_ties_and_unusable_vectors(spark, max_heads):
    rng = np.random.default_rng(3)
    v = rng.normal(size=4)
    n = 300
    extra = [(1000, None, 0.0), (1001, [0.0] * 4, 0.0), (1002, [1.0] * 3, 0.0), (1003, [float("nan"), 1.0, 1.0, 1.0], 0.0), (1004, [None, 1.0, 1.0, 1.0], 0.0), (1005, [float("inf"), 1.0, 1.0, 1.0], 0.0), (None, [1.0] * 4, 0.0)]
    df = _table(spark, range(n), np.tile(v, (n, 1)) * 2.0 ** rng.integers(-3, 3, (n, 1)), extra).repartition(5)
    got = defaultdict(list)
    for r in vectors.similar_vectors(df, dim=4, k=10, cell_rows=50, max_heads=max_heads, **NEAR).orderBy("rank").collect():
        got[r["row_id"]].append(r["neighbor_id"])
        assert r["similarity"] == 1.0
    assert set(got) == set(range(n))
    for i in range(n):
        assert got[i] == [j for j in range(11) if j != i][:10]
    assert vectors.similar_vectors(df.limit(0), dim=4).count() == 0
    assert vectors.similar_pairs(df.where("row_id >= 1000"), dim=4).count() == 0
    twice = _table(spark, [1, 1, 2], np.tile(v, (3, 1)))
    assert {tuple(r) for r in vectors.similar_pairs(twice, dim=4).collect()} == {(1, 2)}


def test_copies_take_the_list_of_the_first(spark):
    v = np.eye(3)[0]
    m = np.array([v] * 6 + [[1, 0.1, 0], [0, 1, 0]])
    got = defaultdict(list)
    for r in vectors.similar_vectors(_table(spark, range(8), m), dim=3, k=3).orderBy("rank").collect():
        got[r["row_id"]].append(r["neighbor_id"])
    assert got[5] == [0, 1, 2] and got[0] == [1, 2, 3]
    apart = _table(spark, range(9), np.array([[1, 0, 0], [1, 1e-7, 0]] * 4 + [[0, 1, 0]]))  # equal after rounding, not in bytes
    want = {(a, b) for a in range(8) for b in [x for x in range(8) if x != a][:3]}
    assert {(r["row_id"], r["neighbor_id"]) for r in vectors.similar_vectors(apart, dim=3, k=3, **NEAR).collect()} == want


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(0).normal(size=(5, 32)).astype(np.float32)
    y = vectors._hadamard(x.copy()) / np.sqrt(32)
    assert np.allclose(x @ x.T, y @ y.T, atol=1e-4)


def _clusters(rows, t=0.7):
    sets = {}
    for i, s in rows:
        w = frozenset(x for x in re.findall("[а-яёa-z0-9]+", (s or "").lower()) if len(x) >= 4 and not x.isdigit())
        if len(w) >= 8:
            sets[i] = w
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) * 10 >= 7 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in ids:
        groups[find(i)].append(i)
    return {(min(g), i) for g in groups.values() if len(g) >= 3 for i in g if i != min(g)}


@pytest.mark.parametrize("hot, cap, pairs", [(20_000, 16_384, 32), (5, 8, 32), (0, 3, 0), (20_000, 16_384, 0)])
def test_row_clusters_against_brute_force(spark, monkeypatch, hot, cap, pairs):
    whole = setjoin.by_cell
    if pairs == 0:  # every cell as if it were large
        monkeypatch.setattr(setjoin, "by_cell", lambda keys, work, bulk=None: whole(keys, work))
    rng = random.Random(7)
    common = [f"общее{chr(1072 + i)}" for i in range(10)]
    rows = [(900, None), (901, ""), (902, "мало слов"), (903, "1234567 " * 30)]
    for g in range(25):
        base = rng.sample(common, 5) + [f"имя{chr(1072 + g)}{chr(1072 + i)}" for i in range(9)]
        for _ in range(rng.randrange(1, 7)):
            w = [x for x in base if rng.random() > 0.12] + rng.sample(common, rng.randrange(2))
            rng.shuffle(w)
            rows.append((len(rows) * 3, " ".join(w).upper() if rng.random() < 0.3 else ", ".join(w)))
    rows += [(5000 + i, rows[10][1]) for i in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "row_id bigint, col1 string, key int").repartition(4)
    got = {tuple(r) for r in setjoin.similar_row_clusters(df, hot_df=hot, cell_cap=cap, pairs_a_row=pairs).collect()}
    assert got == _clusters(rows)
    assert setjoin.similar_row_clusters(df.limit(0)).count() == 0


@pytest.mark.parametrize("task_rows", [20_000, 150])
def test_mixture(spark, task_rows):
    rng = random.Random(1)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("альфа", "бета", "гамма", "дельта")]
    rows = [(i, " ".join(rng.choices(topics[i % 4], k=12))) for i in range(400)] + [(1000, None), (1001, "  "), (1002, "?!")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "row_id bigint, col1 string, cluster_id int")
    got = mixture.mixture_clusters(df, dims=6, task_rows=task_rows)
    labels = {r["row_id"]: r["cluster_id"] for r in got.collect()}
    assert {labels[i] for i in (1000, 1001, 1002)} == {-1} and len(labels) == 403
    by = defaultdict(lambda: defaultdict(int))
    for i in range(400):
        by[labels[i]][i % 4] += 1
    assert sum(max(v.values()) for v in by.values()) / 400 > 0.9
    assert sorted(by) == list(range(len(by)))
    d = {r["cluster_id"]: r for r in mixture.describe(got, typical=3).collect()}
    assert sum(r["size"] for r in d.values()) == 403 and all(len(r["typical_ids"]) <= 3 for r in d.values())
    assert mixture.mixture_clusters(df.limit(0)).count() == 0
    assert mixture.mixture_clusters(df.limit(1)).count() == 1


def test_equal_rows_stay_one_component(spark):
    df = spark.createDataFrame([(i, "одна и та же жалоба") for i in range(60)], "row_id bigint, col1 string")
    for task_rows in (20_000, 10):
        got = mixture.mixture_clusters(df, dims=4, task_rows=task_rows).collect()
        assert len(got) == 60 and {r["cluster_id"] for r in got} == {0} and len({r["log_density"] for r in got}) == 1


def test_log_density_by_hand():
    m = mixture.Mixture(np.array([1.0]), np.zeros((1, 2)), np.array([[[2.0, 0.3], [0.3, 1.0]]]))
    x = np.array([[0.5, -1.0]])
    c = m.covariances[0]
    want = -0.5 * (x[0] @ np.linalg.inv(c) @ x[0]) - 0.5 * np.log(np.linalg.det(c)) - np.log(2 * np.pi)
    assert np.allclose(m.log_joint(x)[0, 0], want)


def test_components_are_split_while_the_criterion_falls():
    rng = np.random.default_rng(5)
    x = 30 * np.eye(8)[np.arange(800) % 8][:, :6] + rng.normal(size=(800, 6))
    fits = mixture.fit_rows(x, parts=(2, 4, 8))
    assert all(f.settled for f in fits)
    for f in fits:  # the criterion is that of the model given, not of one before it
        ll = mixture._logsumexp(f.model.log_joint(x)).sum()
        assert abs(f.criterion - (f.model.parameters * np.log(len(x)) - 2 * ll)) < 1e-6
    label, density, settled = mixture.grow(x, parts=(2,))
    assert settled.all() and np.isfinite(density).all()
    by = defaultdict(set)
    for i, c in enumerate(label):
        by[c].add(i % 8 if i % 8 < 6 else 6)  # two of the eight centres fall together
    assert len(by) == 7 and all(len(v) == 1 for v in by.values())
    assert not mixture.fit_rows(x, parts=(8,), iterations=2)[1].settled


def test_rare_words_weigh_and_zero_bags_have_no_cluster(spark):
    rows = [(i, f"общее слово редкое{i}") for i in range(1000)] + [(2000, "единственное"), (2001, "")]
    got = {r["id"]: r["x"] for r in mixture.reduced_features(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", 4).collect()}
    assert 2000 in got and 2001 not in got
    assert len({tuple(got[i]) for i in range(1000)}) > 250
    found, bags = mixture._bags(pa.array(["раз", "два три"]), np.zeros(1 << mixture.SKETCH_BITS))
    assert len(found) == len(bags) == 0
