"""Text expressions: cleaning, tokens, stop words, light stemming.  Null text reads as empty."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the ticket analysis, everyday words and the domain's own.
STOP_BASE = (
    "и или а но да не ни в во на за из к ко с со у о об от до по при для про через это этот эта эти тот та те как что чтобы если я мы ты вы он она они мне меня ему ей им их "
    "мой моя мое мои твой твоя твое твои ваш ваша ваше ваши наш наша наше наши бы же ли был была было были будет будут есть может могу можно нужно хочу хотел хотела"
).split()
STOP_DOMAIN = ["клиент"]
# The stop words of the CSV clustering.
STOP_CSV = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до "
    "вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь "
    "этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно наш друг про картинка при пожалуйста"
).split()
# The stop words of the classifier.
STOP_CLASSIFIER = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до "
    "вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой "
    "совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем сказать всех никогда сегодня сегодняшний"
).split()
# The word endings the stemmer strips.
ENDINGS = "иями|ями|ами|ем|ом|ми|ям|ам|ей|ов|ев|ия|ья|а|я|у|ю|о|е|ы|и|ь"

WORD_CHARS = r"[\p{L}\p{N}_]+"
TICKET_CHARS = "[а-яёa-z0-9]+"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"


def text_of(c: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def _words(*words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in sorted(set().union(*words))])


def word_tokens(c: str | Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(WORD_CHARS), F.lit(0))


def ticket_tokens(c: str | Column) -> Column:
    """Runs of а-я, a-z and digits of the lower-cased text, ё read as е."""
    return F.regexp_extract_all(F.translate(F.lower(text_of(c)), "ё", "е"), F.lit(TICKET_CHARS), F.lit(0))


def clean_tokens(c: str | Column, stop_words: Iterable[str] = (*STOP_BASE, *STOP_DOMAIN), min_chars: int = 2, drop_numbers: bool = True) -> Column:
    """:func:`ticket_tokens` without short words, stop words and (optionally) numbers; order and repeats kept."""
    stop = _words(stop_words)
    keep = lambda x: (F.length(x) >= min_chars) & ~F.array_contains(stop, x) & (~x.rlike("^[0-9]+$") if drop_numbers else F.lit(True))
    return F.filter(ticket_tokens(c), keep)


def without(tokens: str | Column, words: Column) -> Column:
    """Tokens that are not in an array of words; order and repeats kept."""
    return F.filter(F.col(tokens) if isinstance(tokens, str) else tokens, lambda x: ~F.array_contains(words, x))


def letters_only(c: str | Column, literal: bool = False) -> Column:
    """Lower-cased text with everything but letters replaced by single spaces.

    ``literal`` replaces the letters instead and keeps the rest: the behaviour
    of the studied pattern, which contradicts its own description.
    """
    t = F.regexp_replace(F.lower(text_of(c)), LETTERS if literal else r"[^\p{L}\p{Nl}\p{No}]+", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def letter_tokens(c: str | Column, literal: bool = False) -> Column:
    return F.regexp_extract_all(letters_only(c, literal), F.lit(LETTERS), F.lit(0))


def stem(word: Column) -> Column:
    """Strips the longest common ending where three characters remain; words up to three stay."""
    cut = F.regexp_replace(word, f"({ENDINGS})$", "")
    return F.when((F.length(word) > 3) & (F.length(cut) >= 3), cut).otherwise(word)


def stemmed_tokens(c: str | Column, stop_words: Iterable[str] = STOP_CSV) -> Column:
    """Words of two characters or more that are neither stop words nor numbers, stemmed; ё stays."""
    stop = _words(stop_words)
    words = F.regexp_extract_all(F.lower(text_of(c)), F.lit(TICKET_CHARS), F.lit(0))
    kept = F.filter(words, lambda x: ~F.array_contains(stop, x) & (F.length(x) >= 2) & ~x.rlike("^[0-9]+$"))
    return F.transform(kept, stem)


def normalised(c: str | Column) -> Column:
    """Lower case, ё as е, addresses of pages out, only а-я, a-z and single spaces left."""
    t = F.translate(F.lower(text_of(c)), "ё", "е")
    t = F.regexp_replace(t, r"(?U)https?://\S+|www\.\S+", " ")
    t = F.regexp_replace(t, r"(?U)[^а-яa-z\s-]", " ")
    t = F.regexp_replace(F.regexp_replace(t, "-+", " "), r"(?U)\s+", " ")
    return F.trim(t)


def classifier_tokens(clean: Column, stop_words: Iterable[str] = STOP_CLASSIFIER) -> Column:
    """Words of a :func:`normalised` text, without single letters and stop words."""
    stop = _words(stop_words)
    return F.filter(F.split(clean, " "), lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))
