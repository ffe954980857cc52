"""N-gram expressions: arrays of words or characters to arrays of grams.

Characters are split and grams are joined from neighbours; cutting substrings
out of a long text for every gram would be quadratic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EMPTY = "array<string>"


def _grams(items: Column, n: int, sep: str) -> Column:
    """The grams of exactly ``n`` items; ``n`` = 0 gives one empty gram more than there are items.

    Built by zipping the grams one shorter with the items further on.  No lambda
    refers to an array from outside: such an expression would be computed again
    for every element.
    """
    if n == 0:
        return F.array_repeat(F.lit(""), F.size(items) + 1)
    grams = items
    for k in range(2, n + 1):
        longer = F.zip_with(grams, F.slice(items, k, 1 << 30), lambda g, x: F.concat(g, F.lit(sep), x))
        grams = F.filter(longer, lambda g: g.isNotNull())
    return grams


def word_ngrams(tokens: Column, n_min: int = 1, n_max: int = 2, sep: str = " ", prefix: str = "") -> Column:
    """Word grams, shorter first, in order of position."""
    grams = F.concat(*[_grams(tokens, n, sep) for n in range(n_min, n_max + 1)])
    return F.transform(grams, lambda g: F.concat(F.lit(prefix), g)) if prefix else grams


def chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast(_EMPTY))


def char_ngrams(text: Column, n_min: int = 3, n_max: int = 5, prefix: str = "") -> Column:
    """Character grams of a whole text, across spaces, shorter first."""
    return word_ngrams(chars(text), n_min, n_max, "", prefix)


def spaceless_char_ngrams(text: Column, n_min: int = 2, n_max: int = 5) -> Column:
    """Character grams of a text with its spaces deleted, so across words."""
    return char_ngrams(F.translate(text, " ", ""), n_min, n_max)


def token_char_ngrams(tokens: Column, n_min: int = 2, n_max: int = 5, prefix: str = "") -> Column:
    """Character grams inside each token, token by token; shorter tokens have none."""
    return F.flatten(F.transform(tokens, lambda t: char_ngrams(t, n_min, n_max, prefix)))


def ticket_ngrams(stems: Column, n_min: int = 1, n_max: int = 2, char_n: int = 3) -> Column:
    """Words joined by ``_`` under ``w:`` and character grams inside stems under ``c:``."""
    return F.concat(word_ngrams(stems, n_min, n_max, "_", "w:"), token_char_ngrams(stems, char_n, char_n, "c:"))


def padded_char_ngrams(clean: Column, n_min: int = 3, n_max: int = 5, gram_filter: str = "[а-я]", prefix: str = "c:") -> Column:
    """Character grams of the text with a space at either end that match ``gram_filter``."""
    grams = F.filter(char_ngrams(F.concat(F.lit(" "), clean, F.lit(" ")), n_min, n_max), lambda g: g.rlike(gram_filter))
    return F.transform(grams, lambda g: F.concat(F.lit(prefix), g))


def mixed_ngrams(chars_of: Column, tokens: Column, words: tuple[int, int] = (1, 2)) -> Column:
    """Character grams, then word grams, without prefixes: equal strings are one feature."""
    return F.concat(chars_of, word_ngrams(tokens, *words))
