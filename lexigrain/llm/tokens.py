"""Encoding of a corpus with a public byte-level BPE tokenizer (monoid tree reduction).

Encodings form a monoid under concatenation of their texts.  A long text is
halved recursively; leaves are encoded on their own, and neighbours are joined
by encoding again a window around the seam that grows until the split into
pretokens provably agrees with that of the right half:

* A pretoken starts wherever the one before ended and depends only on the text
  from its start on, so from the first common pretoken start on both splits agree.
* To the left of the seam only the last two pretokens of the left half can
  change: the pattern looks one character past a match at most, and its longest
  literal alternatives ('ll, 've, 're) have three characters.

BPE merges never cross pretokens, so ids outside the window stay as they are.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_TOKENIZER = os.environ.get("LEXIGRAIN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published split pattern of this byte-level BPE vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 128
MAX_VOCABULARY_BYTES = 32 << 20
CACHED = 200_000  #: pretokens whose ids a task remembers


def read_vocabulary(path: str) -> bytes:
    """The tokenizer file, read on the driver; tasks get its bytes, at most ``MAX_VOCABULARY_BYTES``."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


@dataclass
class Encoding:
    """A part of a text: where it starts and ends, the starts of its pretokens, and the ids of each."""

    start: int
    end: int
    starts: list[int]
    ids: list[tuple[int, ...]]


class TreeEncoder:
    """Encodes texts with the vocabulary by tree reduction over leaves of ``leaf`` characters, and decodes."""

    def __init__(self, vocabulary: bytes, leaf: int = LEAF_CHARS):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(PATTERN)
        self.leaf = max(1, leaf)
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty texts."""
        return [i for piece in self._reduce(text).ids for i in piece] if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of its ids: bytes are concatenated up the tree, as a character may be spread over tokens."""
        parts = [self.bytes_of[i] for i in ids]
        while len(parts) > 1:
            parts = [a + b for a, b in zip_longest(parts[::2], parts[1::2], fillvalue=b"")]
        return parts[0].decode() if parts else ""

    def _of(self, piece: str) -> tuple[int, ...]:
        got = self.known.get(piece)
        if got is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            got = tuple(self.bpe._core_bpe.encode_single_piece(piece.encode()))
            if len(piece) <= 32:
                self.known[piece] = got
        return got

    def _encode_leaf(self, text: str, start: int, end: int) -> Encoding:
        pieces = self.split.findall(text, start, end)  # they cover the leaf without gaps
        return Encoding(start, end, list(accumulate(map(len, pieces[:-1]), initial=start)), [self._of(p) for p in pieces])

    def _reduce(self, text: str) -> Encoding:
        """Bottom-up over a stack of leaves: each joins while it is as large as its left neighbour."""
        stack: list[Encoding] = []
        for a in range(0, len(text), self.leaf):
            stack.append(self._encode_leaf(text, a, min(len(text), a + self.leaf)))
            while len(stack) > 1 and stack[-2].end - stack[-2].start <= stack[-1].end - stack[-1].start:
                right = stack.pop()
                stack[-1] = self._join(text, stack[-1], right)
        while len(stack) > 1:
            right = stack.pop()
            stack[-1] = self._join(text, stack[-1], right)
        return stack[0]

    def _join(self, text: str, left: Encoding, right: Encoding) -> Encoding:
        """Encodes again from the last two pretokens of the left half on, until a start of the right half is met."""
        keep = max(0, len(left.starts) - 2)
        at, i = left.starts[keep], -1
        starts, ids = left.starts[:keep], left.ids[:keep]
        while at < right.end:
            if at >= right.start:
                i = bisect_left(right.starts, at)
                if i < len(right.starts) and right.starts[i] == at:
                    break
            m = self.split.match(text, at, right.end)
            starts.append(at)
            ids.append(self._of(m.group()))
            at = m.end()
        else:
            i = len(right.starts)
        return Encoding(left.start, right.end, starts + right.starts[i:], ids + right.ids[i:])


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, leaf: int = LEAF_CHARS) -> DataFrame:
    """``id, ids ARRAY<INT>`` for every row, without special tokens.

    Null and empty texts give an empty list; repeated rows are encoded each;
    strings that spell a special token are ordinary text; an empty table gives
    an empty result.  One narrow pass over two columns.
    """
    vocabulary = read_vocabulary(tokenizer)
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(vocabulary, leaf)
        for b in batches:
            texts = b.column(1)
            for lo in range(0, b.num_rows, 512):  # keeps the lists of a batch small
                part = [encoder.encode(x) for x in texts.slice(lo, 512).to_pylist()]
                offsets = np.zeros(len(part) + 1, np.int32)
                np.cumsum([len(x) for x in part], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(part), np.int32, int(offsets[-1]))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 512), ids], ["id", "ids"])

    out = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``id, text`` from ``id, ids``: what :func:`encode_corpus` has read; an empty or null list gives an empty text.  One narrow pass."""
    vocabulary = read_vocabulary(tokenizer)
    schema = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encoder.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], ["id", "text"])

    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
