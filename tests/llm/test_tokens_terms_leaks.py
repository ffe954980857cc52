"""Token ids, term counts and leaks against direct computations."""

import os
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexigrain.llm import leakage, terms, tokens

HAVE = os.path.exists(tokens.DEFAULT_TOKENIZER)
needs_vocabulary = pytest.mark.skipif(not HAVE, reason="no tokenizer file")
ENCODERS = {n: tokens.TreeEncoder(tokens.read_vocabulary(tokens.DEFAULT_TOKENIZER), n) for n in (1, 2, 3, 7, 64, 10**9)} if HAVE else {}


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sсt rелlve  \n\t12!?…'🙂é́​你"), max_size=60))
def test_tree_reduction_equals_the_whole_encoding(text):
    whole = list(ENCODERS[10**9].encode(text))
    for n, e in ENCODERS.items():
        assert list(e.encode(text)) == whole, (n, text)


@needs_vocabulary
@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_any_unicode(text):
    text = text.encode("utf-8", "ignore").decode()
    assert list(ENCODERS[3].encode(text)) == list(ENCODERS[10**9].encode(text))


@needs_vocabulary
def test_long_runs_and_the_library_agree():
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(tokens.DEFAULT_TOKENIZER.replace(".tiktoken", ".json"))
    ref.encode_special_tokens = True
    for text in ("а" * 5000, " " * 3000 + "x", "'ll" * 900, "ab cd\n\n" * 700, "<|endoftext|> и ещё", "0" * 4000):
        assert list(ENCODERS[64].encode(text)) == ref.encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_corpus_table(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Привет, мир!", "z"), (3, "Привет, мир!", "z"), (4, "a" * 100_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode_corpus(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and got[2][1] == list(ENCODERS[10**9].encode("Привет, мир!"))
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in df.collect()}
    assert tokens.encode_corpus(df).schema["ids"].dataType.simpleString() == "array<int>"


def _count(rows):
    occ, seen = Counter(), Counter()
    for r in rows:
        here = set()
        for c, v in enumerate(r):
            for w in re.findall("[а-яёa-z0-9]+", (v or "").lower()):
                if len(w) > 1 and not w.isdigit():
                    occ[w, c] += 1
                    here.add(w)
        seen.update(here)
    return occ, seen


def test_term_counts(spark):
    rng = random.Random(2)
    pool = ["кот", "Пёс", "ёж", "x1", "a", "12", "да-нет", "рыба"]
    rows = [(" ".join(rng.choices(pool, k=6)), rng.choice([None, "", "кот", "общий кот"])) for _ in range(200)] + [(None, None), ("", " ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "col1 string, col2 string, term int").repartition(6)
    occ, seen = _count(rows)
    got = {r["term"]: r for r in terms.term_counts(df, ["col1", "col2"]).collect()}
    assert set(got) == set(seen)
    for t, r in got.items():
        assert (r["n_col1"], r["n_col2"], r["n_total"], r["n_rows"]) == (occ[t, 0], occ[t, 1], occ[t, 0] + occ[t, 1], seen[t])
        assert r["mark"] == ("rare" if seen[t] < 3 else "common" if seen[t] > 0.25 * len(rows) else None)
    ids = [r["term_id"] for r in terms.term_counts(df, ["col1", "col2"]).collect()]
    assert sorted(ids) == list(range(len(seen)))
    assert terms.term_counts(df.limit(0), ["col1", "col2"]).count() == 0


def test_words_as_read():
    same = ["Ещё один СЛУЧАЙ", "еще  один случай!", "*Ещё* «один»\n> случай", "Е​ще oдин сл­учай", "Eщё oдин cлyчaй"]
    assert {tuple(leakage.words(x)) for x in same} == {("еще", "один", "случай")}
    assert leakage.words(None) == leakage.words("") == []


def _brute(docs, items, n):
    out = {}
    for d, text in docs:
        a = leakage.words(text)
        for i, item in items:
            b = leakage.words(item)
            best = 0
            for x in range(len(a)):
                for y in range(len(b)):
                    k = 0
                    while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                        k += 1
                    best = max(best, k)
            if best >= n:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"слово{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 12, 25])))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(60):
        body = rng.choices(vocab + ["иное"], k=30)
        if d % 3 == 0:
            w = (items[rng.randrange(12)][1] or "").split()
            at, cut = rng.randrange(20), rng.randrange(max(1, len(w) - 4))
            body[at:at] = [x.upper() if rng.random() < 0.3 else x + "," for x in w[cut : cut + rng.choice([4, 5, 9])]]
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1])]
    dd = spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, item_id int").repartition(3)
    ii = spark.createDataFrame([(*x, "s") for x in items], "item_id bigint, text string, split string")
    for n in (4, 6):
        want = _brute(docs, items, n)
        for block in (5, 1000):
            got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in leakage.leaks(dd, ii, min_words=n, block_items=block).collect()}
            assert got == want
    left = leakage.without_leaks(dd, ii, min_words=4)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in _brute(docs, items, 4)}
    assert leakage.leaks(dd, ii.limit(0)).count() == 0 and leakage.leaks(dd.limit(0), ii).count() == 0


def test_suffix_array_orders_suffixes():
    import numpy as np

    rng = random.Random(1)
    for _ in range(20):
        ids = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 40))] + [-3])
        order = leakage.suffix_array(ids, np.arange(len(ids)))
        assert [tuple(ids[i:]) for i in order] == sorted(tuple(ids[i:]) for i in range(len(ids)))
