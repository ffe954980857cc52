"""The most similar vectors of every vector (multiprobe cross-polytope hashing).

Centred unit vectors are turned by fast Hadamard pseudo-rotations (random signs
and a Walsh-Hadamard transform, three times) and fall into the cell of the
nearest signed axis.  How many axes a digit has, and how many digits a cell,
follows from the number of vectors before anything is hashed, so that cells keep
their size and a vector its number of copies, whatever the size of the data.
Each vector is kept in its own cell of every table and also looks into the next
nearest cells.  A large cell is hashed once more within its task, where copies
cost no shuffle.  Candidates are reranked by the exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise
from .cells import by_cell, split_hot

K = 10
TABLES, PROBES = 4, 4  #: without a threshold, where neighbours may be far apart
NEAR_TABLES, NEAR_PROBES, NEAR_RATIOS = 2, 2, (0.85, 0.92)  #: for pairs of at least 0.9; the ratio by the number of digits
NEAR = 0.9
CELL_ROWS = 4096  #: vectors a cell holds on average
LOCAL_ROWS = 16_384  #: rows of a cell that are compared all with all; larger ones are hashed again within the task
HOT_ROWS = 131_072  #: rows of a cell above which it gets further digits before the shuffle
MAX_HOT = 100_000  #: cells that may get further digits; beyond, all cells get more axes
MAX_HEADS = 50_000  #: groups of copies that skip the tables; copies of smaller groups go through them
DEPTH = 3
ROTATIONS = 3
DECIMALS = 6
APART = -4.0  #: in place of the similarity of rows that are not compared, below any least similarity
_MIX = np.int64(0x5851F42D4C957F2D)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists are usable, and these as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, int)
    valid = ~column.is_null().to_numpy(zero_copy_only=False) & (lengths == dim)
    flat = column.filter(pa.array(valid)).flatten()
    nulls = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if nulls is not None:
        m = m.copy()
        m[nulls.reshape(-1, dim)] = np.nan
    good = np.isfinite(m).all(1) & (m != 0).any(1)
    at = np.flatnonzero(valid)
    valid[at[~good]] = False
    return valid, m[good]


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)  # keeps squares of tiny and huge values in range
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, in place, in log2 steps."""
    n, h = x.shape[1], 1
    while h < n:
        v = x.reshape(len(x), n // (2 * h), 2, h)
        a = v[:, :, 0, :] + v[:, :, 1, :]
        v[:, :, 1, :] = v[:, :, 0, :] - v[:, :, 1, :]
        v[:, :, 0, :] = a
        h *= 2
    return x


def directions(unit: np.ndarray) -> np.ndarray:
    """A 64-bit key of each direction: equal for vectors that differ in length only."""
    weights = np.random.default_rng(64).integers(-(1 << 62), 1 << 62, unit.shape[1]) | 1
    with np.errstate(over="ignore"):
        return (np.round(unit * (1 << 22)).astype(np.int64) * weights).sum(1)


class Hasher:
    """Cells of the cross-polytope hash: one digit for each number of ``axes``."""

    def __init__(self, dim: int, centre: np.ndarray, seed: int, axes: tuple[int, ...] = ()):
        self.dim, self.width, self.centre, self.seed, self.axes = dim, 1 << max(0, (dim - 1).bit_length()), centre, seed, axes

    def digit(self, unit: np.ndarray, number: int, axes: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, nearness relative to the nearest) of the ``probes`` nearest signed axes among the first ``axes``, nearest first."""
        signs = np.random.default_rng([self.seed, number]).choice(np.array([-1, 1], np.float32), (ROTATIONS, self.width))
        x = np.zeros((len(unit), self.width), np.float32)
        x[:, : self.dim] = unit - self.centre
        for s in signs:
            x = _hadamard(x * s) / np.float32(np.sqrt(self.width))
        x = x[:, :axes]
        a = np.abs(x)
        some = min(probes, axes)
        if some == 1:
            order = a.argmax(1)[:, None]
        elif some < axes:
            order = np.argpartition(-a, some - 1, axis=1)[:, :some]
        else:
            order = np.repeat(np.arange(axes)[None], len(a), 0)
        near = np.take_along_axis(a, order, 1)
        by = np.argsort(-near, axis=1, kind="stable")
        order, near = np.take_along_axis(order, by, 1), np.take_along_axis(near, by, 1)
        codes = 2 * order + (np.take_along_axis(x, order, 1) > 0)
        return codes.astype(np.int64), near / np.maximum(near[:, :1], 1e-30)

    def cells(self, unit: np.ndarray, table: int, probes: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(cells, whether to go there), own cell first: probing cells differ from it in one digit, the nearest of all digits first."""
        own, options = np.full(len(unit), table, np.int64), []
        digits = [self.digit(unit, table * (len(self.axes) + 1) + i, axes, probes) for i, axes in enumerate(self.axes)]
        scale = [1]
        for axes in self.axes:
            scale.append(scale[-1] * 2 * axes)
        for (codes, _), s in zip(digits, scale):
            own = own + 1_000 * codes[:, 0] * s
        for (codes, near), s in zip(digits, scale):
            for j in range(1, codes.shape[1]):
                options.append((near[:, j], own + 1_000 * (codes[:, j] - codes[:, 0]) * s))
        cells, go = [own], [np.ones(len(unit), bool)]
        if options and probes > 1:
            near, where = np.stack([o[0] for o in options], 1), np.stack([o[1] for o in options], 1)
            best = np.argsort(-near, axis=1, kind="stable")[:, : probes - 1]
            for j in range(best.shape[1]):
                pick = best[:, j : j + 1]
                cells.append(np.take_along_axis(where, pick, 1)[:, 0])
                go.append(np.take_along_axis(near, pick, 1)[:, 0] >= max(ratio, 1e-9))
        return np.stack(cells, 1), np.stack(go, 1)

    def refined(self, unit: np.ndarray, cells: np.ndarray, hot: list[np.ndarray]) -> np.ndarray:
        """The cells with a further digit for each level in whose (sorted) list they are."""
        for level, listed in enumerate(hot):
            at = np.minimum(np.searchsorted(listed, cells), len(listed) - 1)
            inside = listed[at] == cells
            if not inside.any():
                break
            rows = np.flatnonzero(inside.any(1))
            code = self.digit(unit[rows], 100_000 + level, self.width, 1)[0]
            with np.errstate(over="ignore"):
                further = cells[rows] * _MIX + code + 1
            cells[rows] = np.where(inside[rows], further, cells[rows])
        return cells


def axes_for(n: int, dim: int, cell_rows: int = CELL_ROWS) -> tuple[int, ...]:
    """Axes of each digit, so that ``n`` vectors spread over cells of about ``cell_rows``; none where one cell is enough.

    A further digit costs recall, so cells may be twice as large before there is one.
    """
    width, out, wanted = 1 << max(0, (dim - 1).bit_length()), [], n / cell_rows
    while wanted > (2 if out else 1):
        need = min(width, max(1, 1 << max(0, int(np.ceil(np.log2(wanted / 2))))))
        out.append(need)
        wanted /= 2 * need
    return tuple(out)


def summary(vectors: DataFrame, vec_col: str, dim: int) -> tuple[np.ndarray, int]:
    """Mean of all unit vectors and their number; partial sums by partition, ``dim + 1`` numbers to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1)
        for b in batches:
            _, m = _matrix(b.column(0), dim)
            if len(m):
                total += np.append(_unit(m).sum(0), len(m))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["x"])

    sums = vectors.select(F.col(vec_col).cast("array<float>").alias("v")).mapInArrow(run, "x array<double>")
    got = sums.agg(*[F.sum(F.col("x")[i]) for i in range(dim + 1)]).first()
    n = int(got[dim] or 0)
    return np.array([got[i] / n for i in range(dim)]) if n else np.zeros(dim), n


def _usable(b: pa.RecordBatch, dim: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Ids, lists and unit vectors of the usable rows of ``id, vec``."""
    ok, m = _matrix(b.column(1), dim)
    keep = pa.array(ok)
    return b.column(0).filter(keep), b.column(1).filter(keep), _unit(m) if len(m) else m


def _copies(base: DataFrame, dim: int, k: int, max_heads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sorted; first id; id of the last that goes through the tables) of the largest groups of more than ``k + 1`` copies.

    Groups are counted with partial sums; at most ``max_heads`` rows reach the
    driver.  A group that is not among them goes through the tables.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, _, unit = _usable(b, dim)
            if len(ids):
                yield pa.RecordBatch.from_arrays([ids, pa.array(directions(unit))], ["id", "key"])

    keyed = base.mapInArrow(keys, T.StructType([base.schema["id"], T.StructField("key", T.LongType())]))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).orderBy(F.desc("n"), "key").limit(max_heads)
    large = materialise(large.select("key"))
    if not large.limit(1).count():
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    # the limit of the rank is taken before the shuffle as well, so a task sends k + 1 ids of a key at most
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    heads = keyed.join(F.broadcast(large), "key").withColumn("place", place).where(F.col("place") <= k + 1)
    got = heads.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).orderBy("key").toArrow()
    return tuple(got.column(c).to_numpy() for c in ("key", "first", "last"))


def _followers(ids: np.ndarray, unit: np.ndarray, heads: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are copies beyond the first of their group, and the place of the group in ``heads``."""
    keys, _, last = heads
    if not len(keys) or not len(ids):
        return np.zeros(len(ids), bool), np.zeros(len(ids), int)
    key = directions(unit)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return (keys[at] == key) & (ids > last[at]), at


def _best(ids: np.ndarray, probe: np.ndarray, m: np.ndarray, k: int, least: float, chunk: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, similarity) of each row's ``k`` best; probing rows are not compared with each other, nor rows of one ``chunk``."""
    order = np.lexsort((ids, probe))
    ids, probe, m = ids[order], probe[order], m[order]
    chunk = None if chunk is None else chunk[order]
    f = m.astype(np.float32)
    kept = int((~probe).sum())
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    block = max(64, (1 << 23) // max(1, len(ids)))
    for lo in range(0, len(ids) if kept else 0, block):
        hi = min(len(ids), lo + block)
        cols = len(ids) if lo < kept else kept
        s = f[lo:hi] @ f[:cols].T
        if lo < kept < hi:
            s[kept - lo :, kept:] = APART
        if chunk is not None:
            s[chunk[lo:hi, None] == chunk[None, :cols]] = APART
        s[ids[lo:hi, None] == ids[None, :cols]] = APART
        near = s >= least - 1e-4
        many = np.flatnonzero(near.sum(1) > 4 * k) if cols > k else ()
        if len(many):  # only what can be among the k best goes on
            limit = np.partition(s[many], cols - k, axis=1)[:, cols - k]
            near[many] &= s[many] >= limit[:, None] - 1e-5
        i, j = np.nonzero(near)
        if not len(i):
            continue
        sim = np.empty(len(i))
        for a in range(0, len(i), 200_000):
            sim[a : a + 200_000] = np.einsum("ij,ij->i", m[lo + i[a : a + 200_000]], m[j[a : a + 200_000]])
        sim = np.round(sim, DECIMALS)
        ok = sim >= least
        i, j, sim = i[ok] + lo, j[ok], sim[ok]
        by = np.lexsort((ids[j], -sim, i))
        i, j, sim = i[by], j[by], sim[by]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((order[i[top]], order[j[top]], sim[top]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _search(ids: np.ndarray, probe: np.ndarray, m: np.ndarray, k: int, least: float, hasher: Hasher, tables: int, probes: int, local_rows: int, depth: int = 0):
    """As :func:`_best`, through tables of this task where there are more than ``local_rows`` rows."""
    if len(ids) <= local_rows or depth == DEPTH:
        return _best(ids, probe, m, k, least)
    found, unit = [], m.astype(np.float32)
    for t in range(tables):
        codes = hasher.digit(unit, 200_000 + 1_000 * depth + t, hasher.width, probes)[0]
        code, row = codes.T.ravel(), np.tile(np.arange(len(ids)), codes.shape[1])
        looks = np.repeat(np.arange(codes.shape[1]) > 0, len(ids))
        by = np.argsort(code, kind="stable")
        code, row, looks = code[by], row[by], looks[by]
        edges = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code))
        for a, b in zip(edges, edges[1:]):
            if b - a > 1 and not looks[a:b].all():
                r = row[a:b]
                deeper = b - a < len(ids)  # a cell that holds everything is not worth another digit
                i, j, sim = _search(ids[r], looks[a:b], m[r], k, least, hasher, tables, probes, local_rows, depth + 1 if deeper else DEPTH)
                found.append((r[i], r[j], sim))
    i, j, sim = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
    by = np.lexsort((ids[j], -sim, i))
    i, j, sim = i[by], j[by], sim[by]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])  # equal pairs have equal similarities and stand together
    i, j, sim = i[new], j[new], sim[new]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], j[top], sim[top]


def _rank_cell(k: int, least: float, hasher: Hasher, tables: int, probes: int, local_rows: int):
    """All rows of one cell -> each row's ``k`` best among them."""

    def work(t: pa.Table) -> pa.RecordBatch | None:
        ids, probe, chunk = t.column("id").to_numpy(), t.column("probe").to_numpy(), t.column("chunk").to_numpy()
        if probe.all():
            return None
        m = _unit(t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, hasher.dim))
        if t.column("c1")[0] != t.column("c2")[0]:
            i, j, sim = _best(ids, probe, m, k, least, chunk)
        else:
            i, j, sim = _search(ids, probe, m, k, least, hasher, tables, probes, local_rows)
        if not len(i):
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(sim)], ["id", "neighbor_id", "similarity"])

    return work


def _hot_cells(base: DataFrame, hasher: Hasher, heads, tables: int, probes: int, ratio: float, hot: list[np.ndarray], cap: int) -> np.ndarray:
    """Cells of more than ``cap`` rows, sorted; tasks send their counts, not rows.  No more than ``MAX_HOT + 1`` reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending = [], 0

        def flush():
            code, n = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return code, np.bincount(n, np.concatenate([h[1] for h in held])).astype(np.int64)

        for b in batches:
            ids, _, unit = _usable(b, hasher.dim)
            if not len(ids):
                continue
            unit = unit[~_followers(ids.to_numpy(), unit, heads)[0]].astype(np.float32)
            for t in range(tables):
                cells, go = hasher.cells(unit, t, probes, ratio)
                code, n = np.unique(hasher.refined(unit, cells, hot)[go], return_counts=True)
                held.append((code, n))
                pending += len(code)
            if pending > 4_000_000:
                held = [flush()]
                pending = len(held[0][0])
        if held:
            code, n = flush()
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["cell", "n"])

    counts = base.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > cap)
    return np.sort(counts.select("cell").limit(MAX_HOT + 1).toArrow().column("cell").to_numpy())


def similar_vectors(
    vectors: DataFrame, id_col: str = "row_id", vec_col: str = "vec", dim: int = 64, k: int = K, min_similarity: float | None = None,
    tables: int = TABLES, probes: int = PROBES, probe_ratio: float | tuple[float, ...] = 0.0, cell_rows: int = CELL_ROWS, local_rows: int = LOCAL_ROWS,
    hot_rows: int = HOT_ROWS, max_heads: int = MAX_HEADS, seed: int = 42,
) -> DataFrame:
    """``id, neighbor_id, similarity, rank``: for every usable vector the ``k`` most similar others (of at least ``min_similarity``, if given).

    The similarity is the cosine in double precision, rounded to 6 decimals;
    ties go to the smaller id.  Vectors that are null, zero, of another size
    or hold a null, NaN or infinite element take no part; a row without an id
    takes none either, and an id that occurs twice is never its own neighbour.
    Ids are integers.  An empty table gives an empty result.

    A vector goes to its own cell in each table and to up to ``probes - 1``
    further ones that are at least ``probe_ratio`` as near (a tuple: by the number
    of digits).  Cells of more than ``hot_rows`` rows get up to three further
    digits; what is still as large is compared chunk by chunk, exactly.

    Copies have the same direction.  Of more than ``k + 1`` copies the first
    ``k + 1`` by id go through the tables: they alone can be in a list, as ties go
    to the smaller id.  The others take the first of their group and its list, so
    copies never meet in pairs.  Should a group not be among the ``max_heads``
    largest, all of it goes through the tables.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    least = -2.0 if min_similarity is None else min_similarity
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id IS NOT NULL")
    centre, n = summary(base, "vec", dim)
    heads = _copies(base, dim, k, max_heads)
    axes = axes_for(n, dim, cell_rows)
    while True:
        hasher = Hasher(dim, centre.astype(np.float32), seed, axes)
        ratio = probe_ratio if isinstance(probe_ratio, float) else probe_ratio[min(len(axes), len(probe_ratio)) - 1]
        hot: list[np.ndarray] = []
        found_hot = _hot_cells(base, hasher, heads, tables, probes, ratio, hot, hot_rows) if n > hot_rows else np.empty(0, np.int64)
        while 0 < len(found_hot) <= MAX_HOT and len(hot) < DEPTH:
            hot.append(found_hot)
            found_hot = _hot_cells(base, hasher, heads, tables, probes, ratio, hot, hot_rows)
        if len(found_hot) <= MAX_HOT:
            break
        axes = axes_for(n, dim, cell_rows := max(1, cell_rows // 4))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vec, unit = _usable(b, dim)
            if not len(ids):
                continue
            active = ~_followers(ids.to_numpy(), unit, heads)[0]
            ids, vec, unit = ids.filter(pa.array(active)), vec.filter(pa.array(active)), unit[active].astype(np.float32)
            for t in range(tables):
                cells, go = hasher.cells(unit, t, probes, ratio)
                cells = hasher.refined(unit, cells, hot)
                for j in range(cells.shape[1]):
                    at = pa.array(np.flatnonzero(go[:, j]))
                    yield pa.RecordBatch.from_arrays([pa.array(cells[go[:, j], j]), ids.take(at), pa.array(np.full(len(at), j > 0)), vec.take(at)], ["cell", "id", "probe", "vec"])

    rows = base.mapInArrow(spread, "cell bigint, id bigint, probe boolean, vec array<float>")
    if len(found_hot):
        rest = spark.createDataFrame(pa.table({"cell": found_hot}), "cell bigint")
        sizes = rows.select("cell").join(F.broadcast(rest), "cell").groupBy("cell").agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("chunks"))
        cells = split_hot(rows, materialise(sizes), "cell", "id")
    else:
        cells = rows.select("*", *[F.lit(0).alias(c) for c in ("chunk", "c1", "c2")])
    cells = cells.select("cell", "c1", "c2", "id", "probe", "chunk", "vec")
    schema = "id bigint, neighbor_id bigint, similarity double"
    work = _rank_cell(k, least, hasher, tables, max(probes, 2), local_rows)
    found = cells.repartition("cell", "c1", "c2").sortWithinPartitions("cell", "c1", "c2").mapInArrow(by_cell(3, work), schema)
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbor_id")
    lists = found.groupBy("id", "neighbor_id").agg(F.max("similarity").alias("similarity")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if len(heads[0]):
        lists = materialise(lists)
        lists = lists.unionByName(_follower_lists(base, lists, heads, dim, k))
    return lists.select(F.col("id").cast(id_type).alias(id_col), F.col("neighbor_id").cast(id_type).alias("neighbor_id"), "similarity", "rank")


def _follower_lists(base: DataFrame, lists: DataFrame, heads: tuple[np.ndarray, np.ndarray, np.ndarray], dim: int, k: int) -> DataFrame:
    """Lists of the copies that skipped the tables: the first of the group, then the list of that one, without the last place."""
    first = heads[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, _, unit = _usable(b, dim)
            follows, at = _followers(ids.to_numpy(), unit, heads)
            if follows.any():
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(follows)), pa.array(first[at[follows]])], ["id", "first"])

    follows = base.mapInArrow(run, "id bigint, first bigint")
    firsts = base.sparkSession.createDataFrame(pa.table({"first": np.unique(first)}), "first bigint")
    of_first = lists.withColumnRenamed("id", "first").join(F.broadcast(firsts), "first", "left_semi").select("first", "neighbor_id", "similarity")
    own = firsts.select("first", F.col("first").alias("neighbor_id"), F.lit(1.0).alias("similarity"))
    order = Window.partitionBy("first").orderBy(F.desc("similarity"), "neighbor_id")
    ranked = of_first.unionByName(own).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # at most max_heads groups of k rows
    return follows.join(F.broadcast(ranked), "first").select("id", "neighbor_id", "similarity", "rank")


def similar_pairs(vectors: DataFrame, id_col: str = "row_id", min_similarity: float = NEAR, **options) -> DataFrame:
    """``<id>_a, <id>_b`` with a < b: pairs of at least ``min_similarity`` of which at least one is in the other's list."""
    options = {"tables": NEAR_TABLES, "probes": NEAR_PROBES, "probe_ratio": NEAR_RATIOS, **options}
    n = similar_vectors(vectors, id_col=id_col, min_similarity=min_similarity, **options)
    return n.select(F.least(id_col, "neighbor_id").alias(f"{id_col}_a"), F.greatest(id_col, "neighbor_id").alias(f"{id_col}_b")).distinct()
