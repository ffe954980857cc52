"""Occurrences and rows of every distinct term, with the too rare and too common marked.

Each block of rows is encoded with a dictionary of its own and counted into
arrays (occurrences by column, rows); a task adds up its blocks.  The distinct
terms of all tasks get the global integer dictionary: dense ids in the order of
partition and term.  The tasks' counts are encoded with it, and the arrays of
every range of identifiers are summed in one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

NOT_TERM = "[^а-яёa-z0-9]+"
MIN_ROWS = 3
MAX_SHARE = 0.25
HELD = 1_000_000  #: terms of blocks a task holds before it adds them up
RANGE = 4096  #: identifiers whose arrays are summed together


def _block_counts(columns: list[pa.Array], min_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """Terms of a block, occurrences by term and column, rows by term."""
    n, words, owner, column = len(columns[0]), [], [], []
    for c, values in enumerate(columns):
        lists = pc.split_pattern_regex(pc.fill_null(values, ""), NOT_TERM)
        words.append(pc.list_flatten(lists))
        owner.append(pc.list_parent_indices(lists).to_numpy())
        column.append(np.full(len(words[-1]), c, np.int64))
    coded = pa.concat_arrays([w.cast(pa.string()) for w in words]).dictionary_encode()
    terms = coded.dictionary
    if not len(terms):
        return None
    good = pc.and_(pc.greater_equal(pc.utf8_length(terms), min_chars), pc.invert(pc.match_substring_regex(terms, "^[0-9]*$")))
    new = np.cumsum(good.to_numpy(zero_copy_only=False)) - 1
    ok = good.to_numpy(zero_copy_only=False)
    code, row, col = coded.indices.to_numpy(), np.concatenate(owner).astype(np.int64), np.concatenate(column)
    use = ok[code]
    code, row, col = new[code[use]].astype(np.int64), row[use], col[use]
    k = int(ok.sum())
    occ = np.bincount(code * len(columns) + col, minlength=k * len(columns)).reshape(k, len(columns))
    pairs = code * n + row
    pairs.sort()
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:] != pairs[:-1]
    rows = np.bincount(pairs[first] // n, minlength=k)
    return terms.filter(good), occ, rows


def task_counts(df: DataFrame, columns: Sequence[str], min_chars: int) -> DataFrame:
    """``term, o0..., n_rows``: what each task has counted over its blocks."""
    names = [*(f"o{i}" for i in range(len(columns))), "n_rows"]
    lowered = df.select(*[F.lower(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(columns)])

    def added(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).group_by("term").aggregate([(n, "sum") for n in names])
        return t.select(["term", *(f"{n}_sum" for n in names)]).rename_columns(["term", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            got = _block_counts([b.column(i) for i in range(len(columns))], min_chars) if b.num_rows else None
            if got:
                terms, occ, rows = got
                held.append(pa.table([terms, *(pa.array(occ[:, i]) for i in range(len(columns))), pa.array(rows)], names=["term", *names]))
                size += len(terms)
            if size > HELD:
                t = added(held)
                if t.num_rows > HELD // 2:  # too many distinct ones to go on with
                    yield from t.to_batches(max_chunksize=65_536)
                    held, size = [], 0
                else:
                    held, size = [t], t.num_rows
        if held:
            yield from added(held).to_batches(max_chunksize=65_536)

    return lowered.mapInArrow(run, "term string, " + ", ".join(f"{n} bigint" for n in names))


def global_dictionary(terms: DataFrame) -> DataFrame:
    """``term, term_id``: ids dense from 0 in the order of partition and term; ``terms`` may hold a term more than once."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], ["term", "part", "local"])
            at += b.num_rows

    placed = materialise(terms.select("term").distinct().sortWithinPartitions("term").mapInArrow(number, "term string, part int, local bigint"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # one row a partition
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return placed.join(F.broadcast(starts), "part").select("term", (F.col("start") + F.col("local")).alias("term_id"))


def term_counts(df: DataFrame, columns: Sequence[str], min_chars: int = 2, min_rows: int = MIN_ROWS, max_share: float = MAX_SHARE) -> DataFrame:
    """``term_id, term, n_<column>..., n_total, n_rows, mark`` of every distinct term.

    Terms are the maximal runs of а-я, ё, a-z, 0-9 in the lower-cased values, at
    least ``min_chars`` long and not digits only.  ``mark`` is ``rare`` (fewer
    than ``min_rows`` rows), ``common`` (more than ``max_share`` of all rows) or
    null; rare wins.  Null and empty values have no terms but their rows count;
    repeated rows count each; an empty table gives an empty result.  ``term_id``
    is dense from 0.

    Only totals of tasks are shuffled, not occurrences, so a term that is in
    every row costs one line a task.
    """
    n_rows = df.count()
    names = [*(f"o{i}" for i in range(len(columns))), "n_rows"]
    counted = materialise(task_counts(df, columns, min_chars))
    words = materialise(global_dictionary(counted))
    encoded = counted.join(words, "term").select("term_id", *names).repartition(F.floor(F.col("term_id") / RANGE))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count arrays of the ranges of a task: one row an identifier, one column a count."""
        arrays: dict[int, np.ndarray] = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            values = np.stack([b.column(i).to_numpy() for i in range(1, b.num_columns)], 1)
            for r in np.unique(ids // RANGE):
                at = ids // RANGE == r
                np.add.at(arrays.setdefault(int(r), np.zeros((RANGE, len(names)), np.int64)), ids[at] % RANGE, values[at])
        for r, a in arrays.items():
            used = np.flatnonzero(a[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(r * RANGE + used), *(pa.array(a[used, i]) for i in range(len(names)))], ["term_id", *names])

    summed = encoded.mapInArrow(ranges, "term_id bigint, " + ", ".join(f"{n} bigint" for n in names))
    mark = F.when(F.col("n_rows") < min_rows, "rare").when(F.col("n_rows") > F.lit(max_share) * F.lit(n_rows), "common")
    total = sum((F.col(f"o{i}") for i in range(1, len(columns))), F.col("o0"))
    return summed.join(words, "term_id").select("term_id", "term", *[F.col(f"o{i}").alias(f"n_{c}") for i, c in enumerate(columns)], total.alias("n_total"), "n_rows", mark.alias("mark"))
