"""Text decoded with the wrong character encoding: found and restored (round-trip repair).

A round trip encodes text under a legacy encoding it may have been read in and
strictly decodes the bytes as the encoding it may have been written in; nested
damage is undone layer by layer.  Every reading is priced by a model of letter
pairs that is trained on all values of the collection, in which characters that
only damage produces have a fixed high price.  A reading is accepted when the
price of a stretch of words drops by more than a margin.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings in which damaged text may have been read, and in which it may have been written.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5", "mac-roman", "cp437")
WRITTEN_AS = ("utf-8", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5")
MARGIN, LAYERS, SWITCH, LOST = 20.0, 3, 6.0, 13.0
MIN_CHANGED = 4  #: characters that a reading must give, as any bytes can be read in a single-byte encoding
STRICT_MARGIN = 12.0  #: for readings by UTF-8 alone, without loss, of words with characters of damage: sound text hardly ever decodes so
LAYER_PRICE = 4.0  #: bits a further layer must save
_LETTERS = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
# Everyday words, the prior of the pair model for small collections.
_PRIOR = (
    "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой весь год от так о для ты же все тот мочь вы человек такой его сказать только или ещё бы себя один как уже до время если сам когда другой вот говорить наш мой знать стать при чтобы дело жизнь кто первый очень два день её новый рука даже во со раз где там под можно ну какой после их работа без самый потом надо хотеть ли слово идти большой должен место иметь ничто сейчас здравствуйте пожалуйста заказ доставка оплата возврат товар магазин покупка договор ремонт гарантия обращение проверка клиент служба поддержка ответ срок номер город мастер склад замена отказано отправлено проверено"
)
(SPACE, LOWER, UPPER, LAT_L, LAT_U, DIGIT, PUNCT, TYPO, NBSP, ACCENT, CYR, BOX, SYMBOL, CONTROL, REPLACED, OTHER) = (0, 1, 34, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 77, 78, 79)
K = 80
#: Price in bits of a character of a class, whatever stands before it; letters and other everyday classes are priced by the trained pairs.
FIXED_PRICE = {ACCENT: 11.0, CYR: 10.0, BOX: 14.0, SYMBOL: 11.0, CONTROL: 14.0, REPLACED: LOST, OTHER: 16.0, NBSP: 7.0}
#: Bits to tell apart the members of a class that the pairs do not tell apart.
WITHIN = {LAT_L: 4.0, LAT_U: 4.0, DIGIT: 3.3, PUNCT: 3.0, TYPO: 3.0}


def _class_table() -> np.ndarray:
    t = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x20):
        t[c] = CONTROL
    for c in " \t\r\n":
        t[ord(c)] = SPACE
    t[0x21:0x7F] = PUNCT
    t[ord("0") : ord("9") + 1] = DIGIT
    t[ord("a") : ord("z") + 1] = LAT_L
    t[ord("A") : ord("Z") + 1] = LAT_U
    t[0x7F:0xA0] = CONTROL
    t[0xA0:0xC0] = SYMBOL
    t[0xC0:0x250] = ACCENT
    t[0xD7] = t[0xF7] = SYMBOL
    t[0x2B0:0x300] = SYMBOL
    t[0x400:0x530] = CYR
    for i, c in enumerate(_LETTERS):
        t[ord(c)], t[ord(c.upper())] = LOWER + i, UPPER + i
    t[0x2000:0x2070] = SYMBOL
    for c in "«»—–…№“”„’‑‐":
        t[ord(c)] = TYPO
    for c in (0xA0, 0x202F, 0x2009, 0x200B, 0x3000, 0xFEFF):
        t[c] = NBSP
    t[0x2070:0x2500] = SYMBOL
    t[ord("№")] = TYPO
    t[0x2500:0x2600] = BOX
    t[0xFFFD] = REPLACED
    return t


CLASS = _class_table()
_WEIRD = np.isin(np.arange(K), [ACCENT, CYR, BOX, SYMBOL, CONTROL, REPLACED])


def _classes(text: str) -> np.ndarray:
    return CLASS[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def pair_counts(texts: Sequence[str]) -> np.ndarray:
    """Counts of class pairs over texts that show no sign of damage, a K by K array."""
    out = np.zeros(K * K, np.int64)
    c = _classes("\n".join(texts) + "\n")
    ends = np.flatnonzero(c == SPACE)
    # words with characters of damage would teach the model that damage is usual
    starts = np.concatenate([[0], ends[:-1] + 1])
    odd = np.add.reduceat(np.append(_WEIRD[c], 0), starts) > 0 if len(starts) else np.empty(0, bool)
    drop = np.repeat(odd, np.diff(np.append(starts, len(c))))
    pairs = c[:-1].astype(np.int64) * K + c[1:]
    return out + np.bincount(pairs[~drop[:-1]], minlength=K * K)


class PairModel:
    """Prices in bits of characters by the class before them."""

    def __init__(self, counts: np.ndarray):
        prior = pair_counts([_PRIOR, _PRIOR.upper(), _PRIOR.title()])
        n = counts.reshape(K, K).astype(float) + prior.reshape(K, K) * 0.2 + 0.02
        price = -np.log2(n / n.sum(1, keepdims=True))
        price = np.minimum(price, 13.0)
        for c, bits in WITHIN.items():
            price[:, c] += bits
        for c, bits in FIXED_PRICE.items():
            price[:, c] = bits
        # accented letters are letters beside Latin ones
        price[ACCENT, :ACCENT] = price[LAT_L, :ACCENT]
        price[[LAT_L, LAT_U], ACCENT] = 7.0
        price[ACCENT, SPACE] = 4.0
        price[[LAT_L, LAT_U], TYPO] = np.minimum(price[[LAT_L, LAT_U], TYPO], 8.0)
        price[TYPO, [LAT_L, LAT_U]] = np.minimum(price[TYPO, [LAT_L, LAT_U]], 8.0)
        self.price = price.reshape(-1)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Price, length and whether characters of damage occur, of each word."""
        if not words:
            return np.empty(0), np.empty(0), np.empty(0, bool)
        c = _classes("\n" + "\n".join(words) + "\n")
        bits = self.price[c[:-1].astype(np.int64) * K + c[1:]]
        at = np.flatnonzero(c[:-1] == SPACE)
        return np.add.reduceat(bits, at), np.diff(np.append(at, len(c) - 1)), np.add.reduceat(_WEIRD[c[1:]].astype(int), at) > 0


def _stray(e: UnicodeError) -> tuple[bytes, int]:
    """C1 controls stand for bytes the encoding leaves undefined, U+FFFD for a lost one."""
    c = e.object[e.start]
    if "\x80" <= c <= "\x9f":
        return bytes([ord(c)]), e.start + 1
    if c == "�":
        return b"\xff", e.start + 1
    raise e


codecs.register_error("lexigrain.stray", _stray)


def _encodable(encoding: str) -> frozenset[str]:
    ok = {chr(c) for c in range(0xA0)} | {"�"}
    return frozenset(ok | {c for b in range(256) if (c := bytes([b]).decode(encoding, "replace")) != "�"})


_CAN = {e: _encodable(e) for e in READ_AS}


def round_trip(words: list[str], read_as: str, written_as: str) -> list[str | None]:
    """Each word written in ``written_as``, had it been read in ``read_as``; None where that cannot be.

    Lost bytes come back as U+FFFD, so a result without it is a strict decoding.
    """
    can = _CAN[read_as]
    bad = set().union(*map(set, words)) - can if words else set()
    valid = [i for i, w in enumerate(words) if not (bad and not bad.isdisjoint(w))]
    out: list[str | None] = [None] * len(words)
    if valid:
        raw = "\n".join(words[i] for i in valid).encode(read_as, "lexigrain.stray")
        decoded = raw.decode(written_as, "replace").split("\n")
        if len(decoded) != len(valid):
            decoded = [words[i].encode(read_as, "lexigrain.stray").decode(written_as, "replace").replace("\n", "�") for i in valid]
        for i, w in zip(valid, decoded):
            out[i] = None if w == words[i] or re.search("[\t\r ]", w) else w
    return out


STEPS = tuple((e, d) for e in READ_AS for d in WRITTEN_AS if e != d)


_MIXED = re.compile(r"[A-Za-z\u00c0-\u024f][\u0400-\u052f]|[\u0400-\u052f][A-Za-z\u00c0-\u024f]")


def _strict(chain: tuple, text: str) -> bool:
    return "\ufffd" not in text and all(d == "utf-8" for _, d in chain)


def readings(model: PairModel, words: list[str], layers: int = LAYERS) -> list[dict[tuple, tuple[float, str]]]:
    """For each word the readings under every chain of round trips that makes it cheaper: chain -> (price, text).

    A reading with Latin beside Cyrillic letters in a word is none, unless it is
    a strict one of a single layer.
    """
    best: list[dict[tuple, tuple[float, str]]] = [{} for _ in words]
    price = model.words(words)[0]
    level: dict[tuple, tuple[list[int], list[str], np.ndarray]] = {(): (list(range(len(words))), words, price)}
    for _ in range(layers):
        following: dict[tuple, tuple[list[int], list[str], np.ndarray]] = {}
        for chain, (at, texts, before) in level.items():
            for step in STEPS:
                got = round_trip(texts, *step)
                i = [j for j, w in enumerate(got) if w is not None]
                if not i:
                    continue
                made = [got[j] for j in i]
                after, _, weird = model.words(made)
                kept = []
                for k, j in enumerate(i):
                    w = at[j]
                    paid = float(after[k]) + LAYER_PRICE * len(chain)
                    if paid < price[w] - 2.0 and not (_MIXED.search(made[k]) and (chain or not _strict((step,), made[k]))):
                        best[w][(*chain, step)] = (paid, made[k])
                    # another layer below: still strange and no dearer than it was
                    if weird[k] and step[1] == "utf-8" and "�" not in made[k] and after[k] < before[j]:
                        kept.append(k)
                if kept:
                    following[(*chain, step)] = ([at[i[k]] for k in kept], [made[k] for k in kept], after[kept])
        level = following
        if not level:
            break
    return best


def _segments(price: np.ndarray, odd: np.ndarray, free: list[bool], options: list[dict], margin: float) -> list[tuple[int, int, tuple]]:
    """Stretches of words (first, past last, chain) in which one chain makes the text cheaper by ``margin``.

    Less is asked of strict readings of words that show characters of damage.
    """
    chains = sorted({c for o in options for c in o}, key=lambda c: (len(c), c))
    found: list[tuple[float, int, int, tuple]] = []
    for chain in chains:
        run, start = 0.0, None
        peak, end = 0.0, 0
        for i in range(len(price) + 1):
            gain = None
            if i < len(price):
                gain = price[i] - options[i][chain][0] if chain in options[i] else (0.0 if free[i] else -SWITCH)
            if start is not None and (gain is None or run + gain <= 0 or run + gain < peak - 3 * SWITCH):
                changed = [k for k in range(start, end) if chain in options[k]]
                strict = all(odd[k] and _strict(chain, options[k][chain][1]) for k in changed)
                if peak >= (min(margin, STRICT_MARGIN) if strict else margin) and (strict or sum(len(options[k][chain][1]) for k in changed) >= MIN_CHANGED):
                    found.append((peak, start, end, chain))
                start = None
            if gain is not None and start is None and chain in options[i]:
                run, start, peak, end = 0.0, i, 0.0, i
            if start is not None:
                run += gain
                if run > peak:
                    peak, end = run, i + 1
    taken = np.zeros(len(price), bool)
    out = []
    for gain, a, b, chain in sorted(found, key=lambda x: (-x[0], len(x[3]), x[1], x[3])):
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((a, b, chain))
    return sorted(out)


_WORD = re.compile(r"[^ \t\r\n]+")


def repair_batch(model: PairModel, values: list[str | None], margin: float = MARGIN, layers: int = LAYERS) -> list[tuple[str, bool, list[str], float] | None]:
    """For each damaged value (repaired text, restored wholly, round trips, bits saved); None for sound ones."""
    out: list[tuple[str, bool, list[str], float] | None] = [None] * len(values)
    rows = suspects(model, values)
    hit = list(range(len(rows)))
    spans = [[m.span() for m in _WORD.finditer(values[r])] for r in rows]
    words = [values[r][a:b] for r, s in zip(rows, spans) for a, b in s]
    price, _, odd = model.words(words)
    offsets = np.cumsum([0] + [len(s) for s in spans])
    chosen = [j for i in hit for j in range(offsets[i], offsets[i + 1]) if not words[j].isascii()]
    unique = sorted({words[j] for j in chosen})
    table = dict(zip(unique, readings(model, unique, layers)))
    for i in hit:
        value = values[rows[i]]
        lo, hi = offsets[i], offsets[i + 1]
        options = [table.get(w, {}) for w in words[lo:hi]]
        text, at, saved, how = [], 0, 0.0, []
        for a, b, chain in _segments(price[lo:hi], odd[lo:hi], [w.isascii() for w in words[lo:hi]], options, margin):
            changed = [k for k in range(a, b) if chain in options[k]]
            how.append(" > ".join(f"{e}:{d}" for e, d in chain))
            for k in changed:
                x, y = spans[i][k]
                text += [value[at:x], options[k][chain][1]]
                at = y
                saved += price[lo + k] - options[k][chain][0]
        if how:
            repaired = "".join([*text, value[at:]])
            out[rows[i]] = (repaired, "�" not in repaired, list(dict.fromkeys(how)), round(float(saved), 3))
    return out


def suspects(model: PairModel, values: list[str | None]) -> list[int]:
    """Which values hold a word that shows characters of damage, or is dear for its length.

    Works on all values at once; only these few are then read word by word.
    """
    present = [i for i, v in enumerate(values) if v]
    if not present:
        return []
    joined = [values[i].replace("\n", " ").replace("\r", " ") for i in present]
    c = _classes("\n" + "\n".join(joined) + "\n")
    bits = model.price[c[:-1].astype(np.int64) * K + c[1:]]
    at = np.flatnonzero(c[:-1] == SPACE)
    letters = np.add.reduceat(((c[1:] >= LOWER) & (c[1:] < LAT_L)).astype(np.int32), at)
    length = np.diff(np.append(at, len(c) - 1)) - 1
    bad = (np.add.reduceat(_WEIRD[c[1:]].astype(np.int32), at) > 0) | ((letters >= 3) & (np.add.reduceat(bits, at) > 6.2 * length + 6))
    ends = np.cumsum([len(x) + 1 for x in joined])
    return [present[r] for r in np.unique(np.searchsorted(ends, at[bad], side="right"))]


def train(df: DataFrame, fields: Sequence[str]) -> PairModel:
    """The pair model of all values of the fields.  At most ``K * K`` = 6400 sums go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K * K, np.int64)
        for b in batches:
            for i in range(b.num_columns):
                total += pair_counts([x for x in b.column(i).to_pylist() if x])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    rows = df.select(*[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(K * K, np.int64)
    for r in rows:
        counts[r["pair"]] = r["n"]
    return PairModel(counts)


def garbled(df: DataFrame, fields: Sequence[str], id_col: str = "row_id", margin: float = MARGIN, layers: int = LAYERS, model: PairModel | None = None) -> DataFrame:
    """``id, field, text, repaired, restored, round_trips, bits_saved`` of every damaged value.

    ``repaired`` holds U+FFFD where bytes were lost; ``restored`` tells whether
    every byte could be decoded.  Null, empty and sound values have no row; repeated
    rows are treated each; an empty table gives an empty result.  Two narrow
    passes over the fields: the pair model, then the repair.
    """
    model = model or train(df, fields)
    fields = list(fields)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL("field string, text string, repaired string, restored boolean, round_trips array<string>, bits_saved double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, f in enumerate(fields, 1):
                values = b.column(i).to_pylist()
                got = repair_batch(model, values, margin, layers)
                at = [j for j, x in enumerate(got) if x]
                if at:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(at)), pa.array([f] * len(at)), pa.array([values[j] for j in at]), *(pa.array([got[j][k] for j in at]) for k in range(4))],
                        schema.names,
                    )

    out = df.select(df[id_col].alias("id"), *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
