"""Corpus documents that hold passages of evaluation items (suffix arrays over the corpus).

Both sides are read as a reader sees them: words without case, punctuation,
line marks, invisible characters, ё/е and look-alike letters.  Each shard of
the corpus (an Arrow batch) becomes one sequence of word ids and gets a suffix
array; every suffix of every item is binary-searched in it.  The range of
corpus suffixes that share at least ``min_words`` words are the leaks, and the
longest common prefix is the longest verbatim match from there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 10
BLOCK_ITEMS = 5000
# Letters that look like a Cyrillic one, by their lower-case forms.
LOOKALIKES = {
    "a": "а", "b": "в", "c": "с", "e": "е", "h": "н", "i": "і", "j": "ј", "k": "к", "m": "м", "o": "о", "p": "р", "s": "ѕ", "t": "т", "x": "х", "y": "у",
    "α": "а", "β": "в", "ε": "е", "η": "н", "ι": "і", "κ": "к", "μ": "м", "ν": "v", "ο": "о", "ρ": "р", "τ": "т", "υ": "у", "χ": "х", "ё": "е", "ɑ": "а", "ı": "і", "ҡ": "к", "ԁ": "d", "ո": "n", "ս": "u",
}
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()}
_WORD = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[\x00-\x7fЀ-џ‐-‧‰-⁞№«»]*")


_DROP = {c: None for c in range(0x250, 0x110000) if unicodedata.category(chr(c)) in ("Cf", "Mn", "Me")} | {0xAD: None}


def words(text: str | None) -> list[str]:
    """The words of a text as a reader sees them; none for null."""
    if not text:
        return []
    if not _PLAIN.fullmatch(text):
        text = unicodedata.normalize("NFKC", text).translate(_DROP)
    return _WORD.findall(text.lower().translate(_FOLD))


def suffix_array(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The given start positions in lexicographic order of their suffixes (prefix doubling).

    ``ids`` ends with a value below all others; suffixes end at negative values
    only in the sense that these differ from every word of an item.
    """
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    rank, width = rank.astype(np.int64), 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:] if width < n else []
        key = rank * (n + 1) + second + 1
        _, new = np.unique(key, return_inverse=True)
        if new.max(initial=0) == rank.max(initial=0) or new.max(initial=0) == n - 1:
            rank = new.astype(np.int64)
            break
        rank, width = new.astype(np.int64), width * 2
        if width >= n:
            break
    return starts[np.argsort(rank[starts], kind="stable")]


def _prefix_compare(corpus: np.ndarray, at: np.ndarray, query: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix up to ``width``, sign of corpus suffix minus query suffix over it) pairwise."""
    common, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    open_ = np.ones(len(at), bool)
    for d in range(width):
        i = np.flatnonzero(open_)
        if not len(i):
            break
        diff = corpus[at[i] + d] - query[q[i] + d]
        sign[i] = np.sign(diff)
        same = diff == 0
        common[i[same]] += 1
        open_[i[~same]] = False
    return common, sign


class ItemIndex:
    """The items of one block as word ids, padded so that no two items run together."""

    def __init__(self, items: list[tuple], min_words: int):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        seq, owner, starts = [], [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            starts += range(len(seq), len(seq) + len(ids) - min_words + 1)
            seq += ids + [-2]
            owner += [item] * (len(ids) + 1)
        self.seq = np.array(seq + [-2] * (min_words + 1), np.int64)
        self.starts, self.owner = np.array(starts, np.int64), owner

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text no., item suffix start, first word in the text, words in common) of all runs of ``min_words`` or more, as (text, suffix, word, length)."""
        w = self.min_words
        seq, owner, place = [], [], []
        get = self.vocabulary.get
        for no, text in enumerate(texts):
            ids = [get(x, -1) for x in words(text)]
            seq.append(np.array(ids + [-3], np.int64))
            owner.append(np.full(len(ids) + 1, no))
            place.append(np.arange(len(ids) + 1))
        if not seq or not len(self.starts):
            return []
        corpus = np.concatenate(seq)
        # A suffix whose first w words are not all words of items cannot share w words with one.
        bad = np.concatenate([[0], np.cumsum(corpus < 0)])
        starts = np.flatnonzero(bad[w:] == bad[:-w]) if len(corpus) >= w else np.empty(0, np.int64)
        if not len(starts):
            return []
        keep = np.zeros(len(corpus), bool)
        for d in range(w + 1):
            keep[np.minimum(starts + d, len(corpus) - 1)] = True
        # Only runs that hold a possible start are indexed; a separator ends each.
        new = np.cumsum(keep) - 1
        gaps = np.flatnonzero(keep & ~np.concatenate([[True], keep[:-1]]))
        compact = np.insert(corpus[keep], new[gaps], -3)
        origin = np.insert(np.flatnonzero(keep), new[gaps], -1)
        back = np.empty(len(corpus), np.int64)
        back[origin[origin >= 0]] = np.flatnonzero(origin >= 0)
        owner, place = np.concatenate(owner), np.concatenate(place)
        padded = np.concatenate([compact, np.full(w + 1, -3)])
        order = suffix_array(padded, back[starts])
        lo, hi = np.zeros(len(self.starts), np.int64), np.full(len(self.starts), len(order), np.int64)
        first = self._bound(padded, order, lo, hi, strict=False)
        last = self._bound(padded, order, lo, hi, strict=True)
        found = []
        for s, a, b in zip(self.starts, first, last):
            for i in order[a:b]:
                n = w
                while padded[i + n] >= 0 and padded[i + n] == self.seq[s + n]:
                    n += 1
                found.append((int(owner[origin[i]]), int(s), int(place[origin[i]]), n))
        return found

    def _bound(self, corpus: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, strict: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (active := np.flatnonzero(lo < hi)).size:
            mid = (lo[active] + hi[active]) // 2
            _, sign = _prefix_compare(corpus, order[mid], self.seq, self.starts[active], self.min_words)
            left = (sign < 0) | ((sign == 0) & strict)
            lo[active[left]] = mid[left] + 1
            hi[active[~left]] = mid[~left]
        return lo


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, first_word, n_words``: the longest shared run of each document and item.

    ``first_word`` is the place of the run in the document, counted in words
    from 0; ties go to the earlier.  Null and short texts match nothing;
    documents and items that are repeated match each; empty tables give an
    empty result.  The items are the stated query set: they go to all shards in
    blocks of ``block_items``, one pass over the corpus a block.  No shuffle of
    the corpus; only matches move.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("d", docs.schema[doc_id].dataType), T.StructField("i", items.schema[item_id].dataType), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    corpus = docs.select(docs[doc_id].alias("d"), docs[doc_text].cast("string").alias("t"))
    rows = items.select(items[item_id].alias("i"), items[item_text].cast("string").alias("t")).where("t IS NOT NULL").toLocalIterator()
    out, block = None, []

    def scan(block: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(block, min_words)
            for b in batches:
                best: dict[tuple[int, int], tuple] = {}
                for doc, s, place, n in index.matches(b.column(1).to_pylist()):
                    key = (doc, index.owner[s])
                    best[key] = min(best.get(key, (0, 0)), (-n, place))
                if best:
                    ids = b.column(0)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([k[0] for k in best])), pa.array([k[1] for k in best], T_ITEM), pa.array([v[1] for v in best.values()], pa.int64()), pa.array([-v[0] for v in best.values()], pa.int64())],
                        ["d", "i", "first_word", "n_words"],
                    )

        from pyspark.sql.pandas.types import to_arrow_type

        T_ITEM = to_arrow_type(items.schema[item_id].dataType)
        return corpus.mapInArrow(run, schema)

    for r in rows:
        block.append((r["i"], r["t"]))
        if len(block) == block_items:
            out, block = scan(block) if out is None else out.unionByName(scan(block)), []
    if block:
        out = scan(block) if out is None else out.unionByName(scan(block))
    if out is None:
        out = spark.createDataFrame([], schema)
    best = F.min(F.struct((-F.col("n_words")).alias("m"), F.col("first_word").alias("p")))
    return out.groupBy("d", "i").agg(best.alias("b")).select(F.col("d").alias(doc_id), F.col("i").alias(item_id), F.col("b.p").alias("first_word"), (-F.col("b.m")).alias("n_words"))


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no passage of an item, all columns kept."""
    found = leaks(docs, items, doc_id=doc_id, **options).select(doc_id).distinct()
    return docs.join(found, doc_id, "left_anti")
