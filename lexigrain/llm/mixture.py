"""Clusters of similar rows by a Gaussian mixture, each with its size and most typical members.

Texts become hashed, frequency-weighted bags of words; the covariance over all
rows gives principal components, which are standardised.  Expectation-
maximisation fits full covariances with a ridge.  The mixture grows as a tree:
the rows of a component are split again while the Bayesian information criterion
of some number of parts is lower than that of one, so the number of components
follows from the rows and has no limit.  A component too large for one task is
split in passes over all its rows that sum sufficient statistics, for all such
components and all numbers of parts at once; the others go to one task each and
are split to the end there.  The members of highest density represent a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import dense_numbers
from ..scratch import discard, materialise
from ..sums import summed

BAG_DIMS, DIMS, RIDGE, TYPICAL, SKETCH_BITS = 256, 16, 1e-2, 5, 18
PARTS, PASS_PARTS = (2, 4), (4, 16)  #: numbers of parts tried within a task, and by passes over all rows
ITERATIONS, TOLERANCE = 300, 1e-4  #: within a task
PASSES, PASS_TOLERANCE = 40, 1e-3  #: over all rows; what has not settled by then is split further anyway, and marked
TASK_ROWS, MAX_NODES = 20_000, 5_000  #: rows of a component that one task splits; beyond MAX_NODES components of that size, they may be larger
INIT_ROWS = 256  #: rows of a component, least by hash of their id, that the starting means are chosen from
MIN_SHARE = 0.003  #: words in a smaller share of the rows weigh as those in this share
NOT_TERM = "[^а-яёa-z0-9]+"


def _tokens(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of the words of two characters or more that are not digits only."""
    lists = pc.split_pattern_regex(pc.fill_null(values, ""), NOT_TERM)
    coded = pc.list_flatten(lists).cast(pa.string()).dictionary_encode()
    terms = coded.dictionary
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    good = pc.and_(pc.greater_equal(pc.utf8_length(terms), 2), pc.invert(pc.match_substring_regex(terms, "^[0-9]*$"))).to_numpy(zero_copy_only=False)
    h = np.array([xxhash.xxh64_intdigest(t) if g else 0 for t, g in zip(terms.to_pylist(), good)], np.uint64)
    code, row = coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    use = good[code]
    return row[use], h[code[use]]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _idf(df_sketch: np.ndarray, n: int) -> np.ndarray:
    """Weights of the buckets: every word counts, rare ones no more than those of the least share."""
    return np.log(np.minimum((n + 1) / (df_sketch + 1), 1 / MIN_SHARE)) + 1


def _bags(values: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose bag is not zero, and their unit bags (words of equal place and opposite sign can cancel out)."""
    row, h = _tokens(values)
    if not len(row):
        return np.empty(0, np.int64), np.empty((0, BAG_DIMS))
    rows, at = np.unique(row, return_inverse=True)
    sign = 1.0 - 2.0 * (h & np.uint64(1)).astype(float)
    dim = ((h >> np.uint64(1)) % np.uint64(BAG_DIMS)).astype(np.int64)
    x = np.bincount(at * BAG_DIMS + dim, weights=sign * idf[_bucket(h)], minlength=len(rows) * BAG_DIMS).reshape(len(rows), BAG_DIMS)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    some = norm[:, 0] > 1e-9
    return rows[some], x[some] / norm[some]


def reduced_features(df: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """``id, x``: standardised principal components of the rows' bags; rows without words, or with a zero bag, have none."""
    text = df.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("t")).where("id IS NOT NULL")
    n = max(1, text.count())

    def count(total: np.ndarray, b: pa.RecordBatch) -> None:
        row, h = _tokens(b.column(1))
        if len(row):
            bucket = np.unique(row * (1 << SKETCH_BITS) + _bucket(h)) % (1 << SKETCH_BITS)
            total += np.bincount(bucket, minlength=len(total))

    idf = _idf(summed(text, count, 1 << SKETCH_BITS), n)

    def moments(total: np.ndarray, b: pa.RecordBatch) -> None:
        _, x = _bags(b.column(1), idf)
        total += np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])

    total = summed(text, moments, BAG_DIMS * BAG_DIMS + BAG_DIMS + 1)
    m = max(1.0, total[-1])
    mean = total[-BAG_DIMS - 1 : -1] / m
    values, axes = np.linalg.eigh(total[: BAG_DIMS * BAG_DIMS].reshape(BAG_DIMS, BAG_DIMS) / m - np.outer(mean, mean))
    top = np.argsort(-values)[:dims]
    project = axes[:, top] / np.sqrt(np.maximum(values[top], 1e-9))
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.FloatType()))])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _bags(b.column(1), idf)
            if len(rows):
                flat = ((x - mean) @ project).astype(np.float32).ravel()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32)), pa.array(flat))], ["id", "x"])

    return text.mapInArrow(reduce, schema)


def _monomials(x: np.ndarray) -> np.ndarray:
    """1, the coordinates and their products: log densities and sufficient statistics are linear in these."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], 1)


class Mixture:
    """Weights, means and covariances of ``k`` components."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        self.weights, self.means, self.covariances = weights, means, covariances
        self.inverse = np.linalg.inv(np.linalg.cholesky(covariances))
        self.log_scale = np.log(np.maximum(weights, 1e-300)) + np.log(np.abs(np.diagonal(self.inverse, axis1=1, axis2=2))).sum(1) - means.shape[1] / 2 * np.log(2 * np.pi)

        d = means.shape[1]
        precision = self.inverse.transpose(0, 2, 1) @ self.inverse
        pull = np.einsum("kij,kj->ki", precision, means)
        upper = np.triu_indices(d)
        square = np.where(upper[0] == upper[1], -0.5, -1.0) * precision[:, upper[0], upper[1]]
        self.coefficients = np.concatenate([(self.log_scale - 0.5 * (means * pull).sum(1))[:, None], pull, square], 1)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        return self.log_joint_of(_monomials(x))

    def log_joint_of(self, monomials: np.ndarray) -> np.ndarray:
        return monomials @ self.coefficients.T

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + k * d * (d + 1) // 2


def _logsumexp(a: np.ndarray) -> np.ndarray:
    top = a.max(1)
    return top + np.log(np.exp(a - top[:, None]).sum(1))


def _start(sample: np.ndarray, k: int) -> Mixture:
    """Means farthest from each other among the sample, unit covariances."""
    chosen = [sample[np.argmin(((sample - sample.mean(0)) ** 2).sum(1))]]
    gap = ((sample - chosen[0]) ** 2).sum(1)
    reach = np.quantile(gap, 0.9)
    while len(chosen) < k:
        gap = np.minimum(gap, ((sample - chosen[-1]) ** 2).sum(1))
        chosen.append(sample[np.argmax(np.where(gap > reach, -1, gap)) if (gap <= reach).any() else np.argmax(gap)])
    d = sample.shape[1]
    return Mixture(np.full(k, 1 / k), np.array(chosen), np.repeat(np.eye(d)[None], k, 0))


def _expect(model: Mixture, monomials: np.ndarray) -> tuple[np.ndarray, float]:
    """Sufficient statistics of the components, one row each, and the log-likelihood."""
    joint = model.log_joint_of(monomials)
    ll = _logsumexp(joint)
    return np.exp(joint - ll[:, None]).T @ monomials, float(ll.sum())


def _maximise(s: np.ndarray, model: Mixture, ridge: float) -> Mixture:
    """The mixture that the statistics give; a component without rows keeps its place."""
    k, dims = model.means.shape
    upper = np.triu_indices(dims)
    mass = np.maximum(s[:, 0], 1e-9)
    means = s[:, 1 : 1 + dims] / mass[:, None]
    second = np.zeros((k, dims, dims))
    second[:, upper[0], upper[1]] = second[:, upper[1], upper[0]] = s[:, 1 + dims :] / mass[:, None]
    cov = second - np.einsum("ki,kj->kij", means, means)
    empty = s[:, 0] < 1e-6
    means[empty], cov[empty] = model.means[empty], model.covariances[empty]
    cov += ridge * np.eye(dims)
    low = np.linalg.eigvalsh(cov).min(1)
    if low.min() < ridge / 2:
        cov += np.maximum(0, ridge - low)[:, None, None] * np.eye(dims)
    return Mixture(s[:, 0] / max(s[:, 0].sum(), 1e-300), means, cov)


def criterion(model: Mixture, log_likelihood: float, n: int) -> float:
    """The Bayesian information criterion: less is better."""
    return -2 * log_likelihood + model.parameters * np.log(max(n, 1))


class Fit:
    """One mixture on its way: ``step`` takes the sums of a pass; the criterion is that of the model itself, not of one before."""

    def __init__(self, model: Mixture, n: int, tolerance: float, most: int, ridge: float):
        self.model, self.n, self.tolerance, self.most, self.ridge = model, n, tolerance, most, ridge
        self.passes, self.settled, self.done = 0, False, False
        self.log_likelihood = -np.inf

    def step(self, sums: np.ndarray, log_likelihood: float) -> None:
        self.passes += 1
        gain = (log_likelihood - self.log_likelihood) / max(self.n, 1)
        self.log_likelihood = log_likelihood
        # the second model of a single component is exact, as its statistics do not depend on the first
        self.settled = gain < self.tolerance or len(self.model.means) == 1 and self.passes == 2
        self.done = self.settled or self.passes >= self.most
        if not self.done:
            self.model = _maximise(sums, self.model, self.ridge)

    @property
    def criterion(self) -> float:
        return criterion(self.model, self.log_likelihood, self.n)


def best_of(tried: list[Fit]) -> Fit:
    """The fit of least criterion; ties go to fewer components."""
    return min(tried, key=lambda f: (f.criterion, len(f.model.means)))


def _numbers(parts: Sequence[int], n: int) -> list[int]:
    """1, and the numbers of parts that leave two rows each."""
    return [1, *sorted({k for k in parts if 1 < k and 2 * k <= n})]


def fit_rows(x: np.ndarray, parts: Sequence[int] = PARTS, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, ridge: float = RIDGE) -> list[Fit]:
    """Fits of 1 and each number of ``parts`` components to rows in memory."""
    monomials, out = _monomials(x), []
    for k in _numbers(parts, len(x)):
        f = Fit(_start(x[:: max(1, len(x) // INIT_ROWS)], k), len(x), tolerance, max(2, iterations), ridge)
        while not f.done:
            f.step(*_expect(f.model, monomials))
        out.append(f)
    return out


def grow(x: np.ndarray, **options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component, log density in it, whether its fit has settled) of each row: components are split while the criterion falls."""
    label, density, settled = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x), bool)
    todo, done = [np.arange(len(x))] if len(x) else [], 0
    while todo:
        rows = todo.pop()
        fits = fit_rows(x[rows], **options)
        best = best_of(fits)
        part = best.model.log_joint(x[rows]).argmax(1)
        if (part == part[0]).all():
            label[rows], density[rows], settled[rows] = done, fits[0].model.log_joint(x[rows])[:, 0], all(f.settled for f in fits)
            done += 1
        else:
            todo += [rows[part == c] for c in np.unique(part)[::-1]]
    return label, density, settled


def _pass(rows: DataFrame, open_: dict[int, list[Fit]], dims: int) -> None:
    """One step of every unfinished fit, from one pass over the rows of their nodes."""
    width = 1 + dims + dims * (dims + 1) // 2
    moving = [(node, f) for node, fits in open_.items() for f in fits if not f.done]
    models: dict[int, list[tuple[int, Mixture]]] = {}
    size = 0
    for node, f in moving:
        models.setdefault(node, []).append((size, f.model))
        size += len(f.model.means) * width + 1

    def add(total: np.ndarray, b: pa.RecordBatch) -> None:
        x, node = b.column(1).flatten().to_numpy().astype(float).reshape(-1, dims), b.column(2).to_numpy()
        for n in np.unique(node):
            if int(n) in models:
                m = _monomials(x[node == n])
                for at, model in models[int(n)]:
                    sums, ll = _expect(model, m)
                    total[at : at + sums.size] += sums.ravel()
                    total[at + sums.size] += ll

    total, at = summed(rows, add, size), 0
    for _, f in moving:
        k = len(f.model.means)
        f.step(total[at : at + k * width].reshape(k, width), float(total[at + k * width]))
        at += k * width + 1


def _split_by_passes(features: DataFrame, dims: int, task_rows: int, parts: Sequence[int], passes: int, ridge: float) -> tuple[DataFrame, dict[int, tuple[Mixture, bool]]]:
    """(``id, x, node`` with every node small enough for a task or whole; node -> mixture and whether settled of those that stay whole)."""
    whole: dict[int, tuple[Mixture, bool]] = {}
    following = 1
    rows = materialise(features.select("id", "x", F.lit(0).alias("node")))
    while True:
        sizes = {r["node"]: r["n"] for r in rows.groupBy("node").agg(F.count("*").alias("n")).collect() if r["node"] not in whole}
        task_rows = max(task_rows, sum(sizes.values()) // MAX_NODES)
        large = {node: n for node, n in sizes.items() if n > task_rows}
        if not large:
            return rows, whole
        mine = rows.where(F.col("node").isin(list(large)))
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("id"), "id"))
        sample: dict[int, list] = {}
        for r in mine.withColumn("place", place).where(F.col("place") <= INIT_ROWS).select("node", "x").collect():
            sample.setdefault(r["node"], []).append(r["x"])
        open_ = {node: [Fit(_start(np.array(sample[node], float), k), n, PASS_TOLERANCE, max(2, passes), ridge) for k in _numbers(parts, n)] for node, n in large.items()}
        while any(not f.done for fits in open_.values() for f in fits):
            _pass(mine, open_, dims)
        splits: dict[int, tuple[int, Mixture]] = {}
        for node, fits in open_.items():
            best = best_of(fits)
            if len(best.model.means) == 1:
                whole[node] = best.model, all(f.settled for f in fits)
            else:
                splits[node] = following, best.model
                following += len(best.model.means)

        def move(batches: Iterator[pa.RecordBatch], splits=splits) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node = b.column(2).to_numpy().copy()
                x = b.column(1).flatten().to_numpy().astype(float).reshape(-1, dims)
                for n in np.unique(node):
                    if int(n) in splits:
                        at = np.flatnonzero(node == n)
                        first, model = splits[int(n)]
                        node[at] = first + model.log_joint(x[at]).argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node)], ["id", "x", "node"])

        if not splits:
            continue
        moved = materialise(rows.mapInArrow(move, rows.schema))
        if moved.where(F.col("node").isin([first + c for first, model in splits.values() for c in range(len(model.means))])).groupBy("node").count().count() == len(splits):
            # no split has parted any rows: what is left stays whole
            whole |= {first + c: (open_[node][0].model, all(f.settled for f in open_[node])) for node, (first, model) in splits.items() for c in range(len(model.means))}
        discard(rows)
        rows = moved


def mixture_clusters(df: DataFrame, id_col: str = "row_id", text_col: str = "col1", dims: int = DIMS, task_rows: int = TASK_ROWS, parts: Sequence[int] = PARTS, pass_parts: Sequence[int] = PASS_PARTS, passes: int = PASSES, ridge: float = RIDGE) -> DataFrame:
    """``id, cluster_id, log_density, settled`` of every row; rows without words, or whose bag is zero, have cluster -1 and null besides.

    Components are numbered from 0.  ``log_density`` is that of the row in its
    component, a Gaussian; ``settled`` tells whether the fits that left the
    component whole had reached their tolerance.  Repeated rows weigh each; rows
    without an id are left out; an empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType
    features = reduced_features(df, id_col, text_col, dims)
    rows, whole = _split_by_passes(features, dims, task_rows, pass_parts, passes, ridge)
    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("node int, part int, log_density double, settled boolean").fields])

    def density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, node = b.column(1).flatten().to_numpy().astype(float).reshape(-1, dims), b.column(2).to_numpy()
            value, ok = np.zeros(len(node)), np.zeros(len(node), bool)
            for n in np.unique(node):
                at = np.flatnonzero(node == n)
                model, settled = whole[int(n)]
                value[at], ok[at] = model.log_joint(x[at])[:, 0], settled
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.zeros(len(node), np.int32)), pa.array(np.round(value, 6)), pa.array(ok)], schema.names)

    def finish(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        by = np.argsort(t.column("id").to_numpy(), kind="stable")  # the result does not depend on the order of arrival
        t = t.take(pa.array(by))
        x = t.column("x").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, dims)
        label, value, ok = grow(x, parts=parts, ridge=ridge)
        return pa.table([t.column("id"), t.column("node"), pa.array(label), pa.array(np.round(value, 6)), pa.array(ok)], names=schema.names)

    left = rows.where(~F.col("node").isin(list(whole))) if whole else rows
    got = left.groupBy("node").applyInArrow(finish, schema)
    if whole:
        got = got.unionByName(rows.where(F.col("node").isin(list(whole))).mapInArrow(density, schema))
    got = dense_numbers(materialise(got.withColumn("component", F.struct("node", "part"))), "component", "cluster_id").select("id", "cluster_id", "log_density", "settled")
    ids = df.select(F.col(id_col).alias("id")).where("id IS NOT NULL")
    nothing = [F.lit(-1).alias("cluster_id"), F.lit(None).cast("double").alias("log_density"), F.lit(None).cast("boolean").alias("settled")]
    without = ids.join(rows.select("id"), "id", "left_anti").select("id", *nothing)
    return got.unionByName(without).withColumnRenamed("id", id_col)


def describe(clusters: DataFrame, id_col: str = "row_id", typical: int = TYPICAL) -> DataFrame:
    """``cluster_id, size, typical_ids``: the members of highest density first, ties to the smaller id."""
    size = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("log_density"), id_col)
    best = clusters.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    lists = best.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col(id_col).alias("id")))).alias("t"))
    return size.join(lists, "cluster_id").select("cluster_id", "size", F.transform("t", lambda x: x["id"]).alias("typical_ids"))
