"""Rows whose word sets are similar, and the clusters they are connected to.

Exact prefix-filter join.  Equal sets are one class.  Each class lists the words
among its rarest that a similar set must share one of; a word in more than
``hot_df`` sets is replaced by its pairs with the words after it, as similar
sets share at least two words of a prefix longer by one.  Classes under one
signature are compared by bit maps first (never dropping a similar pair), then
by their sets.  A signature under which very many pairs are alike gives only one
earlier partner for each class; what is then still in different components is
compared in a second round, so groups of near-equal sets never become all their
pairs.  Words are ordered by a frequency sketch of fixed size, which
any number of distinct words fits in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import component_roots
from ..scratch import materialise
from .cells import by_cell, hot_cells, split_hot

SIMILARITY, MIN_WORDS, MIN_CHARS, MIN_ROWS = 0.7, 8, 4, 3
SKETCH_BITS, HOT_DF, CELL_CAP, ROW_BLOCK = 18, 20_000, 16_384, 512
PAIRS_A_ROW = 32  #: candidates a row of a signature, beyond which one partner each is taken first
NOT_TERM = "[^а-яёa-z0-9]+"


def _word_hash(terms: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64).view(np.int64)


def batch_sets(values: pa.Array, min_chars: int, min_words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows with enough words, and the sorted hashes of their distinct words; ``values`` are lower case."""
    lists = pc.split_pattern_regex(pc.fill_null(values, ""), NOT_TERM)
    coded = pc.list_flatten(lists).cast(pa.string()).dictionary_encode()
    terms = coded.dictionary
    if not len(terms):
        return np.empty(0, np.int64), []
    good = pc.and_(pc.greater_equal(pc.utf8_length(terms), min_chars), pc.invert(pc.match_substring_regex(terms, "^[0-9]*$"))).to_numpy(zero_copy_only=False)
    hashes = np.zeros(len(terms), np.int64)
    at = np.flatnonzero(good)
    hashes[at] = _word_hash(terms.take(pa.array(at)).to_pylist())
    code, row = coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    use = good[code]
    row, h = row[use], hashes[code[use]]
    by = np.lexsort((h, row))
    row, h = row[by], h[by]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[first], h[first]
    rows, start, n = np.unique(row, return_index=True, return_counts=True)
    keep = n >= min_words
    return rows[keep], [h[a : a + m] for a, m in zip(start[keep], n[keep])]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(sets) + 1, np.int32)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))


def keyed_rows(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_words: int, with_words: bool) -> DataFrame:
    """``id, key[, words]`` of the rows with enough words; the key (16 bytes) is the same for equal sets."""
    fields = [T.StructField("id", df.schema[id_col].dataType), T.StructField("key", T.BinaryType())]
    schema = T.StructType(fields + [T.StructField("words", T.ArrayType(T.LongType()))] * with_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sets = batch_sets(b.column(1), min_chars, min_words)
            if len(rows):
                keys = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), keys, *([_lists(sets)] if with_words else [])], schema.names)

    return df.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("t")).where("id IS NOT NULL").mapInArrow(run, schema)


def frequency_sketch(classes: DataFrame) -> np.ndarray:
    """Number of sets by hash bucket of their words: ``2 ** SKETCH_BITS`` counts, whatever the size of the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            total += np.bincount(_bucket(b.column(0).flatten().to_numpy()), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "n"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    got = classes.select("words").mapInArrow(run, "b int, n bigint").groupBy("b").agg(F.sum("n").cast("bigint").alias("n")).toArrow()
    out[got.column("b").to_numpy()] = got.column("n").to_numpy()
    return out


def needed_overlap(a, b, t: float):
    """Least number of shared words that makes sets of ``a`` and ``b`` words similar."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def signatures(words: np.ndarray, df: np.ndarray, t: float, hot_df: int) -> np.ndarray:
    """The keys under which a set meets every set similar to it."""
    m = len(words)
    prefix = m - int(np.ceil(t * m - 1e-9)) + 1
    n = df[_bucket(words)]
    order = np.lexsort((words, n))[: prefix + 1]
    w, n = words[order], n[order]
    out = [w[i] for i in range(min(prefix, m)) if n[i] <= hot_df]
    hot = np.flatnonzero(n[:prefix] > hot_df)
    pairs = [np.int64(xxhash.xxh64_intdigest(w[i].tobytes() + w[j].tobytes()) - (1 << 63)) for i in hot for j in range(i + 1, len(w))]
    return np.array(out + pairs, np.int64)


def _bitmap(words: np.ndarray) -> bytes:
    bits = np.zeros(128, bool)
    bits[(words.view(np.uint64) % np.uint64(128)).astype(int)] = True
    return np.packbits(bits).tobytes()


def _most_different(largest: int, t: float) -> np.ndarray:
    """By the summed size of two sets, the most bits their maps may differ in if the sets are similar."""
    total = np.arange(largest + 1)
    return np.minimum(total - 2 * needed_overlap(total, 0, t), 255).astype(np.uint8)


def _pairs(a: np.ndarray, b: np.ndarray, dense: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), dense))], ["a", "b", "dense"])


def _cell_work(t: float, pairs_a_row: int | None):
    """Candidates of a cell.  Beyond ``pairs_a_row`` a row, each row has its first partner only, and a last line names the dense cell: signature and chunks."""

    def work(c: pa.Table) -> pa.RecordBatch | None:
        cid, size, chunk = c.column("cid").to_numpy(), np.minimum(c.column("size").to_numpy(), 1 << 13).astype(np.int16), c.column("chunk").to_numpy()
        halves = c.column("c1")[0] != c.column("c2")[0]
        root = c.column("root").to_numpy() if "root" in c.column_names else None
        order = np.lexsort((cid, size))
        cid, size, chunk = cid[order], size[order], chunk[order]
        root = None if root is None else root[order]
        raw = np.frombuffer(b"".join(c.column("bits").to_pylist()), np.uint64).reshape(-1, 2)[order]
        found, many, dense = [], 0, False
        linked = np.zeros(len(cid), bool)
        limit = _most_different(int(2 * size.max(initial=0)), t)
        for lo in range(0, len(cid), ROW_BLOCK):
            hi = min(len(cid), lo + ROW_BLOCK)
            last = int(np.searchsorted(size, size[hi - 1] / t + 1e-9, side="right"))
            differ = np.bitwise_count(raw[lo:hi, None, 0] ^ raw[None, lo:last, 0])
            differ += np.bitwise_count(raw[lo:hi, None, 1] ^ raw[None, lo:last, 1])
            ok = differ <= limit[size[lo:hi, None] + size[None, lo:last]]
            ok[:, : hi - lo] &= np.arange(hi - lo)[:, None] < np.arange(hi - lo)[None, :]
            if halves:
                ok &= chunk[lo:hi, None] != chunk[None, lo:last]
            if root is not None:
                ok &= root[lo:hi, None] != root[None, lo:last]
            if dense:
                j = np.flatnonzero(ok.any(0) & ~linked[lo:last])
                i = ok[:, j].argmax(0)
            else:
                i, j = np.nonzero(ok)
            many += len(i)
            if len(i):
                found.append((lo + i, lo + j))
            if not dense and pairs_a_row is not None and many > pairs_a_row * len(cid):
                dense = True
                i, j = (np.concatenate(x) for x in zip(*found))
                by = np.lexsort((i, j))
                first = by[np.append(True, j[by][1:] != j[by][:-1])]
                found = [(i[first], j[first])]
            if dense:
                linked[found[-1][1]] = True
        if not found:
            return None
        a, b = (np.concatenate(x) for x in zip(*found))
        out = _pairs(cid[a], cid[b], False)
        if dense:
            cell = [c.column("sig")[0].as_py(), (c.column("c1")[0].as_py() << 32) + c.column("c2")[0].as_py()]
            mark = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in cell] + [pa.array([True])], out.schema.names)
            out = pa.Table.from_batches([out, mark]).combine_chunks().to_batches()[0]
        return out

    return work


def _bulk_work(t: float):
    def work(c: pa.Table, cell: np.ndarray) -> pa.RecordBatch | None:
        cid, size, chunk = c.column("cid").to_numpy(), c.column("size").to_numpy().astype(np.int64), c.column("chunk").to_numpy()
        halves = c.column("c1").to_numpy() != c.column("c2").to_numpy()
        raw = np.frombuffer(b"".join(c.column("bits").to_pylist()), np.uint64).reshape(-1, 2)
        found = []
        for d in range(1, len(cid)):  # every row with the one d places on, while any two share a cell
            i = np.flatnonzero(cell[d:] == cell[:-d])
            if not len(i):
                break
            j = i + d
            total = size[i] + size[j]
            differ = np.bitwise_count(raw[i] ^ raw[j]).sum(1)
            ok = (differ <= total - 2 * needed_overlap(total, 0, t)) & ~(halves[i] & (chunk[i] == chunk[j])) & (cid[i] != cid[j])
            found.append((cid[i[ok]], cid[j[ok]]))
        if not found:
            return None
        return _pairs(*(np.concatenate(x) for x in zip(*found)), False)

    return work


def _verified(candidates: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    left = candidates.select("a", "b").distinct().join(classes.select(F.col("cid").alias("a"), F.col("words").alias("wa")), "a")
    both = left.join(classes.select(F.col("cid").alias("b"), F.col("words").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.where(shared >= F.lit(t) * (F.size("wa") + F.size("wb") - shared) - F.lit(1e-9)).select("a", "b")


def _roots(links: DataFrame) -> DataFrame:
    return component_roots(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "cid")


def class_roots(classes: DataFrame, t: float = SIMILARITY, hot_df: int = HOT_DF, cell_cap: int = CELL_CAP, pairs_a_row: int = PAIRS_A_ROW) -> DataFrame:
    """``cid, root`` of the classes that are linked: components under a Jaccard similarity of at least ``t``.  ``classes`` holds ``cid, words``."""
    df = frequency_sketch(classes)
    schema = T.StructType([T.StructField("sig", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bits", T.BinaryType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            offsets, flat, cids = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy(), b.column(0).to_numpy()
            sets = [flat[x:y] for x, y in zip(offsets, offsets[1:])]
            sigs = [signatures(s, df, t, hot_df) for s in sets]
            n = np.array([len(s) for s in sigs])
            at = np.repeat(np.arange(len(sets)), n)
            bits = pa.array([_bitmap(s) for s in sets], pa.binary()).take(pa.array(at))
            size = np.array([len(s) for s in sets], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(cids[at]), pa.array(size[at]), bits], schema.names)

    rows = classes.select("cid", "words").mapInArrow(emit, schema)
    hot = materialise(hot_cells(rows.select("sig"), "sig", cell_cap))
    cells = split_hot(rows, hot, "sig", "cid").select("sig", "c1", "c2", "cid", "size", "bits", "chunk")
    schema = "a bigint, b bigint, dense boolean"
    first = cells.repartition("sig", "c1", "c2").sortWithinPartitions("sig", "c1", "c2").mapInArrow(by_cell(3, _cell_work(t, pairs_a_row), _bulk_work(t)), schema)
    first = materialise(first.distinct())  # the links, and the dense cells, are both read from it
    links = materialise(_verified(first.where("NOT dense"), classes, t))
    roots = _roots(links)
    dense = first.where("dense").select(F.col("a").alias("sig"), F.shiftright("b", 32).cast("int").alias("c1"), F.col("b").bitwiseAND((1 << 32) - 1).cast("int").alias("c2"))
    if not dense.limit(1).count():
        return roots
    again = cells.join(dense, ["sig", "c1", "c2"]).join(roots, "cid", "left").select("sig", "c1", "c2", "cid", "size", "bits", "chunk", F.coalesce("root", "cid").alias("root"))
    second = again.repartition("sig", "c1", "c2").sortWithinPartitions("sig", "c1", "c2").mapInArrow(by_cell(3, _cell_work(t, None)), schema)
    more = _verified(second, classes, t)
    return _roots(links.unionByName(more))


def similar_row_clusters(
    df: DataFrame, id_col: str = "row_id", text_col: str = "col1", t: float = SIMILARITY, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS,
    min_rows: int = MIN_ROWS, hot_df: int = HOT_DF, cell_cap: int = CELL_CAP, pairs_a_row: int = PAIRS_A_ROW,
) -> DataFrame:
    """``first_id, id``: each row of a cluster but its smallest id, which is ``first_id``.

    The words of a row are its distinct terms of ``min_chars`` or more
    characters; rows with fewer than ``min_words`` take no part (null and empty
    texts so).  Rows whose words are equal are one class and never meet in
    pairs; repeated ids count as one row.  Clusters are the components of
    classes linked by a Jaccard similarity of ``t`` or more that have
    ``min_rows`` rows or more.  Ids are integers; an empty table gives an empty
    result.
    """
    full = keyed_rows(df, id_col, text_col, min_chars, min_words, True)
    classes = materialise(full.groupBy("key").agg(F.min("id").cast("bigint").alias("cid"), F.first("words").alias("words")))
    roots = class_roots(classes, t, hot_df, cell_cap, pairs_a_row)
    rows = keyed_rows(df, id_col, text_col, min_chars, min_words, False)
    members = rows.join(classes.select("key", "cid"), "key").join(roots, "cid", "left")
    members = materialise(members.select(F.col("id").cast("bigint").alias("id"), F.coalesce("root", "cid").alias("root")).distinct())  # read twice below
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= min_rows)
    return members.join(sizes, "root").where("id <> first_id").select("first_id", "id")
