"""Text and n-gram expressions against plain Python."""

import re

from lexigrain.functions import ngrams as N
from lexigrain.functions import text as X
from pyspark.sql import functions as F

TEXTS = [
    None, "", "   ", "не не на", "12345 67", "?!...", "один", "дом", "дома", "столами", "Ёлка и ёж", "См. https://a.example/x?y=1 и www.b.example — пере-вод", "Hello World_2 again",
    "Клиент не может войти в личный кабинет", "а б в г", "ОПЛАТА картой, оплата КАРТОЙ", "x" * 5000, "слово " * 800,
]


def _frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")


def _got(spark, expr):
    return [r["x"] for r in _frame(spark).select("doc_id", expr.alias("x")).orderBy("doc_id").collect()]


def _ticket(t):
    return re.findall("[а-яёa-z0-9]+", (t or "").lower().replace("ё", "е"))


def test_tokens(spark):
    assert _got(spark, X.word_tokens("text")) == [re.findall(r"\b\w+\b", (t or "").lower()) for t in TEXTS]
    assert _got(spark, X.ticket_tokens("text")) == [_ticket(t) for t in TEXTS]
    stop = {*X.STOP_BASE, *X.STOP_DOMAIN}
    assert _got(spark, X.clean_tokens("text")) == [[w for w in _ticket(t) if len(w) >= 2 and w not in stop and not w.isdigit()] for t in TEXTS]
    assert _got(spark, X.letter_tokens("text")) == [re.findall(r"[^\W\d_]+", (t or "").lower()) for t in TEXTS]
    assert all(x == [] for x in _got(spark, X.letter_tokens("text", literal=True)))


def _stem(w):
    cut = re.sub(f"({X.ENDINGS})$", "", w)
    return cut if len(w) > 3 and len(cut) >= 3 else w


def test_stems(spark):
    want = [[_stem(w) for w in re.findall("[а-яёa-z0-9]+", (t or "").lower()) if w not in X.STOP_CSV and len(w) > 1 and not w.isdigit()] for t in TEXTS]
    assert _got(spark, X.stemmed_tokens("text")) == want


def test_stem_boundaries(spark):
    rows = spark.createDataFrame([(w,) for w in ("дом", "дома", "домами", "ами", "теми", "оплата")], "w string")
    assert [r[0] for r in rows.select(X.stem(F.col("w"))).collect()] == ["дом", "дом", "дом", "ами", "теми", "оплат"]


def _normal(t):
    t = (t or "").lower().replace("ё", "е")
    t = re.sub(r"https?://\S+|www\.\S+", " ", t)
    return re.sub(r"\s+", " ", re.sub("-+", " ", re.sub(r"[^а-яa-z\s-]", " ", t))).strip()


def test_normalised(spark):
    assert _got(spark, X.normalised("text")) == [_normal(t) for t in TEXTS]


def _grams(items, a, b, sep):
    return [sep.join(items[i : i + n]) for n in range(a, b + 1) for i in range(len(items) - n + 1)]


def test_word_grams(spark):
    toks = X.ticket_tokens("text")
    for a, b in ((1, 2), (0, 1), (2, 3)):
        assert _got(spark, N.word_ngrams(toks, a, b)) == [_grams(_ticket(t), a, b, " ") for t in TEXTS]


def test_char_grams(spark):
    assert _got(spark, N.char_ngrams(X.normalised("text"), 3, 5)) == [_grams(list(_normal(t)), 3, 5, "") for t in TEXTS]
    assert _got(spark, N.spaceless_char_ngrams(X.normalised("text"))) == [_grams(list(_normal(t).replace(" ", "")), 2, 5, "") for t in TEXTS]
    want = [[g for w in _ticket(t) for g in _grams(list(w), 2, 5, "")] for t in TEXTS]
    assert _got(spark, N.token_char_ngrams(X.ticket_tokens("text"))) == want
    padded = [["c:" + g for g in _grams(list(" " + _normal(t) + " "), 3, 5, "") if re.search("[а-я]", g)] for t in TEXTS]
    assert _got(spark, N.padded_char_ngrams(X.normalised("text"))) == padded
