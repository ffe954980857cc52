"""Russian and Latin names of people: which person a spelling means, and other names in the same form.

A spelling is analysed into given name, surname, gender and grammatical case.
The key of a person is made of the lemmas, so that all cases, both scripts and
either order of the words give one key, while another given name gives another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Endings of the singular by case (nominative, genitive, dative, accusative, instrumental, prepositional).
HARD_A = ("а", "ы", "е", "у", "ой", "е")
HUSH_A = ("а", "и", "е", "у", "ой", "е")
SOFT_A = ("я", "и", "е", "ю", "ей", "е")
IYA = ("я", "и", "и", "ю", "ей", "и")
HARD_M = ("", "а", "у", "а", "ом", "е")
SOFT_M = ("й", "я", "ю", "я", "ем", "е")
IY_M = ("й", "я", "ю", "я", "ем", "и")
SIGN_M = ("ь", "я", "ю", "я", "ем", "е")
OV_M = ("", "а", "у", "а", "ым", "е")
OV_F = ("а", "ой", "ой", "у", "ой", "ой")
SKY_M = ("ий", "ого", "ому", "ого", "им", "ом")
SKY_F = ("ая", "ой", "ой", "ую", "ой", "ой")
# Given names whose stem changes in the oblique cases, with that stem.
MOVING = {"павел": "павл", "лев": "льв", "петр": "петр"}
# Latin spellings of the endings of surnames, by gender.
LATIN_OV = re.compile(r"(.+(?:ov|ev|in|yn))(a?)\Z")
LATIN_SKY = re.compile(r"(.+(?:sk|tsk))(iy|y|ii|i|aya|aia|aja)\Z")

_OV = re.compile(r"(.*(?:[оеё]в|[иы]н))(|а|у|ым|е|ой)\Z")
_SKY = re.compile(r"(.*[сц]к)(ий|ой|ого|ому|им|ом|ая|ую)\Z")
_NOUN = re.compile(r"(.*(?:ич|ук|юк|як|ян|ец|ан|ер|ель|ак|ик))(|а|у|ом|ем|е)\Z")


def given_endings(lemma: str) -> tuple[str, tuple[str, ...]]:
    """Stem and endings of a given name."""
    if lemma.endswith("ия"):
        return lemma[:-1], IYA
    if lemma[-1] == "а":
        return lemma[:-1], HUSH_A if lemma[-2] in "гкхжшчщ" else HARD_A
    if lemma[-1] == "я":
        return lemma[:-1], SOFT_A
    if lemma.endswith("ий"):
        return lemma[:-1], IY_M
    if lemma[-1] == "й":
        return lemma[:-1], SOFT_M
    if lemma[-1] == "ь":
        return lemma[:-1], SIGN_M
    return lemma, HARD_M


def given_forms(lemma: str) -> list[str]:
    """The six cases of a given name; names in -о and other vowels, and feminine ones in a consonant, do not change."""
    if lemma[-1] in "оеиуыэю":
        return [lemma] * 6
    if lemma in MOVING:
        return [lemma, *(MOVING[lemma] + e for e in HARD_M[1:])]
    stem, endings = given_endings(lemma)
    return [stem + e for e in endings]


def surname_readings(word: str) -> list[tuple[str, str, int, str]]:
    """(lemma, gender, case, kind) of a folded Cyrillic surname; the lemma is the masculine nominative, gender ``?`` either."""
    out: list[tuple[str, str, int, str]] = []
    if m := _OV.match(word):
        for g, endings in (("m", OV_M), ("f", OV_F)):
            out += [(m.group(1), g, c, "ov") for c, e in enumerate(endings) if e == m.group(2)]
    if m := _SKY.match(word):
        nominative = m.group(2) if m.group(2) in ("ий", "ой") else "ий"
        out += [(m.group(1) + "ий", "m", c, "sky") for c, e in enumerate(SKY_M) if e == m.group(2)]
        out += [(m.group(1) + "ий", "f", c, "sky") for c, e in enumerate(SKY_F) if e == m.group(2)]
        if nominative == "ой":
            out.append((m.group(1) + "ий", "m", 0, "sky"))
    if not out and (m := _NOUN.match(word)):
        out += [(m.group(1), "m", c, "noun") for c, e in enumerate(HARD_M) if e == m.group(2) or (c, m.group(2)) == (4, "ем")]
        if not m.group(2):
            out += [(m.group(1), "f", c, "noun") for c in range(6)]
    return out or [(word, "?", c, "fixed") for c in range(6)]


def surname_form(lemma: str, kind: str, gender: str, case: int) -> str:
    """The surname of a kind in a gender and case."""
    if kind == "ov":
        return lemma + (OV_F if gender == "f" else OV_M)[case]
    if kind == "sky":
        return lemma[:-2] + (SKY_F if gender == "f" else SKY_M)[case]
    if kind == "noun":
        return lemma if gender == "f" else lemma + HARD_M[case]
    return lemma


@dataclass(frozen=True)
class Person:
    """What a spelling says: lemmas (or an initial), gender, case and kind of the surname."""

    given: str
    initial: str
    surname: str
    gender: str
    case: int
    kind: str


def analyse(given: str | None, initial: str, surname: str, given_readings: dict[str, list[tuple[str, str, int]]]) -> Person:
    """The reading in which given name and surname agree in gender and case; the nominative, if several do.

    ``given_readings`` maps folded spellings to (lemma, gender, case).  All words are folded.
    """
    if not re.search("[а-я]", surname):
        lemma, gender, kind = surname, "", "latin"
        if m := LATIN_SKY.match(surname):
            lemma, gender, kind = m.group(1) + "iy", "f" if m.group(2)[0] == "a" else "m", "latin"
        elif m := LATIN_OV.match(surname):
            lemma, gender = m.group(1), "f" if m.group(2) else "m"
        options = given_readings.get(given, []) if given else []
        best = next((o for o in options if not gender or o[1] == gender), options[0] if options else (given or "", gender or "m", 0))
        return Person(best[0], initial, lemma, best[1], 0, kind)
    surnames = surname_readings(surname)
    if given is None:
        lemma, gender, case, kind = min(surnames, key=lambda s: s[2])
        return Person("", initial, lemma, "m" if gender == "?" else gender, case, kind)
    givens = given_readings.get(given) or [(given, "?", c) for c in range(6)]
    fit = [(case, lemma, name, g if g != "?" else gender) for name, g, c in givens for lemma, gender, case, _ in surnames if c == case and ("?" in (g, gender) or g == gender)]
    if fit:
        case, lemma, name, gender = min(fit, key=lambda f: (f[0], f[2], f[1]))
    else:
        (name, gender, case), lemma = min(givens, key=lambda g: g[2]), min(surnames, key=lambda s: s[2])[0]
    kind = next(k for x, _, _, k in surnames if x == lemma)
    return Person(name, initial, lemma, "m" if gender == "?" else gender, case, kind)
