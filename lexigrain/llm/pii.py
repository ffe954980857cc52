"""Personal data in free text: found, and replaced by typed placeholders or keyed surrogates.

Detection works on a reading of the text in which invisible characters are gone
and spaces, dashes and digits are plain; offsets lead back to the text as it is.
Each entity has a key, the same for all its spellings, so that placeholders and
surrogates keep coreference.  Surrogates match the kind, script, grammatical
case, gender and format of what they replace.  Numbers go through a keyed
permutation of their digits, so different ones stay different; words come from
keyed hashing, and those that different entities of a document or collection
would share get a further syllable each.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise
from .people import analyse, given_forms, surname_form

KINDS = ("email", "phone", "id_number", "address", "name")

# Common given names.  Other spellings follow by rule (below).
GIVEN_RU_F = (
    "авдотья агата агафья аглая агния ада аида алевтина александра алина алиса алла альбина анастасия ангелина анжелика анна антонина анфиса ариадна арина ася аэлита белла богдана "
    "валентина валерия варвара василиса вера вероника виктория виолетта влада владислава галина дана дарина дарья диана дина ева евгения евдокия екатерина елена елизавета есения ефросинья жанна зарина зинаида злата зоя "
    "ида илона инга инесса инна ирина ия кира клавдия клара кристина ксения лада лариса лера лиана лидия лилия лина любовь людмила майя маргарита марианна марина мария марта марфа милана мирослава "
    "надежда наталия наталья ника нина нонна оксана олеся ольга полина прасковья раиса регина римма роза роксана руслана сабина светлана серафима снежана софия софья стефания таисия тамара татьяна "
    "ульяна фаина федосья фёкла цветана эвелина элеонора элина эльвира эмма юлиана юлия юнона яна ярослава"
).split()
GIVEN_RU_M = (
    "абрам август аверьян адам адриан аким александр алексей альберт анатолий андрей антон аркадий арсений артём артемий артур афанасий богдан борис вадим валентин валерий василий вениамин виктор виталий владимир владислав всеволод вячеслав "
    "гавриил геннадий георгий герман глеб гордей григорий давид даниил данил данила дементий демьян денис дмитрий добрыня евгений евсей егор елисей емельян ермолай ефим ефрем захар иван игнат игорь илья иннокентий иосиф "
    "казимир карл кирилл клим константин кузьма лаврентий лев леонид леонтий лука макар максим марат марк мартин матвей мирон мирослав митрофан михаил модест моисей назар никита никифор николай олег осип остап павел пахом пётр платон потап прохор "
    "радик ринат роберт родион роман ростислав рудольф руслан рустам савва савелий самуил святослав севастьян семён серафим сергей соломон станислав степан тарас тимофей тимур тихон трофим фёдор федот феликс филипп фома харитон эдуард эльдар эмиль эрик юлиан юлий юрий яков ян ярослав"
).split()
GIVEN_EN = (
    "aaron abigail adam adrian agnes alan albert alice amanda amber amelia amy andrea andrew angela ann anna anthony aron arthur astrid audrey austin barbara beatrice ben benjamin bernard beth bill birgit bob bonnie brandon brenda "
    "brian bruce caleb carl carol caroline catherine charles charlotte chloe christian christina christopher claire clara clive colin connor cora craig cynthia daisy dan daniel dave david deborah dennis derek diana dominic donald donna "
    "dora dorothy douglas dylan ebba edgar edith edmund edward edwin eleanor elena eliza elizabeth ella ellen elsa elsie emily emma eric erik ernest esther ethan eugene eva evelyn felix fiona flora florence frances francis frank fred "
    "freya gabriel gareth gary gavin gemma george gerald gloria gordon grace graham gregory greta gustav gwen hannah harold harriet harry harvey hazel heather hector helen henry hilda holly howard hugh hugo ian ida imogen ingrid irene "
    "iris isaac isabel isla ivan ivy jack jacob jade james jane janet jasmine jason jean jennifer jeremy jessica jill jim joan joanna joe joel john jon jonathan joseph joshua joyce judith julia julian karen kate katherine keith kenneth "
    "kevin kirsten klara kyle lara lars laura lauren leah lena leo leon leonard leonora lewis liam lilian linda lisa liz louis louise lucas lucy luke lydia mabel magnus malcolm marcus margaret maria marina marion mark martha martin "
    "mary matilda matthew maud max meg megan melanie melissa michael michelle mike mila mildred miles miriam molly monica myra nadia nancy naomi natalie nathan neil nicholas nick nicole nigel nils nina noah nora norman olaf olga olive "
    "oliver olivia oscar otto owen pamela patricia patrick paul paula penelope peter philip phoebe rachel ralph raymond rebecca reginald richard robert robin roger roland ronald rosa rose rosemary ruby rupert russell ruth ryan sabrina "
    "sam samantha samuel sandra sarah scott sean selma sharon sheila sidney signe simon sofia sonia sophia sophie stella stephen steve steven stuart sue susan sven sylvia terence teresa theodore theresa thomas tilda tim timothy tina "
    "tobias tom tony tracy trevor ursula valerie vanessa vera vernon veronica victor victoria vincent viola violet virginia vivian walter wanda warren wendy wesley wilfred william winifred yvonne zachary zoe"
).split()
# Latin spellings of Cyrillic letters.
TRANSLIT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}


def latin(word: str) -> str:
    return "".join(TRANSLIT.get(c, c) for c in word)


def _cases(name: str) -> set[str]:
    """The name in the cases of the singular, by the common endings."""
    if name[-1] in "ая":
        stem = name[:-1]
        soft = name[-1] == "я" or stem[-1] in "гкхжшчщ"
        return {name, stem + ("и" if soft else "ы"), stem + "е", stem + ("ю" if name[-1] == "я" else "у"), stem + ("ей" if name[-1] == "я" else "ой"), stem + "и"}
    if name[-1] in "йь":
        return {name, *(name[:-1] + x for x in ("я", "ю", "ем", "е", "и"))}
    return {name, *(name + x for x in ("а", "у", "ом", "е"))}


def _given_names() -> dict[str, str]:
    """Spelling (folded) -> gender."""
    out: dict[str, str] = {}
    for g, names in (("f", GIVEN_RU_F), ("m", GIVEN_RU_M)):
        for n in names:
            for c in _cases(n):
                out.setdefault(c.replace("ё", "е"), g)
        for n in names:
            for v in _latin_spellings(n):
                if len(v) > 2:
                    out.setdefault(v, g)
    for n in GIVEN_EN:
        out.setdefault(n, "f" if n[-1] in "aeyh" and n not in ("george", "luke", "kyle", "terence", "clive", "joshua", "henry", "harry", "anthony", "timothy", "jeremy", "gary", "gregory", "zachary", "sidney", "wesley", "harvey", "theodore", "hugh", "noah", "joseph", "keith", "kenneth", "ralph") else "m")
    return out


def _given_readings() -> dict[str, list[tuple[str, str, int]]]:
    """Spelling (folded) -> (lemma, gender, case); Latin spellings of Cyrillic names have their lemma."""
    out: dict[str, list[tuple[str, str, int]]] = {}
    for g, names in (("f", GIVEN_RU_F), ("m", GIVEN_RU_M)):
        for n in (x.replace("ё", "е") for x in names):
            for case, form in enumerate(given_forms(n)):
                out.setdefault(form, []).append((n, g, case))
    for g, names in (("f", GIVEN_RU_F), ("m", GIVEN_RU_M)):
        for n in (x.replace("ё", "е") for x in names):
            for v in _latin_spellings(n):
                out.setdefault(v, []).append((n, g, 0))
    return out


def _latin_spellings(name: str) -> set[str]:
    spelt = latin(name)
    return {spelt, spelt.replace("yo", "e"), spelt.replace("iy", "y"), spelt.replace("iya", "ia"), spelt.replace("ya", "ia"), spelt.replace("yu", "iu"), spelt.replace("ks", "x"), spelt.replace("y", "i")}


GIVEN = _given_names()
GIVEN_READINGS = _given_readings()
_GIVEN_SET = frozenset(GIVEN)

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_SAME_LENGTH = (
    {c: " " for c in (0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    | {c: "-" for c in (*range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63, 0xFF0D)}
    | {0xFF20: "@", 0xFE6B: "@", 0xFF0B: "+", 0xFF08: "(", 0xFF09: ")", 0xFF0E: "."}
    | {0xFF10 + i: str(i) for i in range(10)}
    | {0x660 + i: str(i) for i in range(10)}
)
_ODD = re.compile(_INVISIBLE.pattern[:-1] + re.escape("".join(map(chr, _SAME_LENGTH))) + "]")


@dataclass(frozen=True)
class Entity:
    """A found piece of personal data: place in the original text, and the key all its spellings share."""

    kind: str
    start: int
    end: int
    text: str
    key: str


class Spans:
    """Disjoint intervals, with a test in logarithmic time."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)

    def within(self, a: int, b: int) -> list[tuple[int, int]]:
        """The intervals that touch [a, b)."""
        i = max(0, bisect_left(self.starts, a) - 1)
        out = []
        while i < len(self.starts) and self.starts[i] < b:
            if self.ends[i] > a:
                out.append((self.starts[i], self.ends[i]))
            i += 1
        return out


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text as it is read, and the original offset of each character (None: the same)."""
    offsets = None
    if text.isascii() and "\t" not in text or not _ODD.search(text):
        return text, None
    if _INVISIBLE.search(text):
        offsets = [i for i, c in enumerate(text) if not _INVISIBLE.match(c)]
        text = _INVISIBLE.sub("", text)
    return text.translate(_SAME_LENGTH), offsets


def lowered(s: str) -> str:
    """Lower case with every character in its place."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(x if len(x := c.lower()) == 1 else c for c in s)


# --- mail addresses -------------------------------------------------------------
_MAIL_SIGNS = ("@", "собак", "собач", "(at", "[at", "{at", "( at", "[ at", " dot ", "(эт", "[эт", "(гав", "<at")
_AT = re.compile(r"@|[(\[{<]\s?(?:at|собака|собачка|эт|гав)\s?[)\]}>]|(?<=\w) (?:собака|собачка|at|AT|СОБАКА) (?=\w)", re.I)
_LOCAL = re.compile(r"[\w+\-]+(?:(?:\.|\s?[(\[](?:dot|точка)[)\]]\s?| (?:dot|точка) )[\w+\-]+)*\Z", re.I)
_DOT = r"(?:\.| \. |\s?[(\[{]\s?(?:dot|точка)\s?[)\]}]\s?| (?:dot|точка) )"
_DOMAIN = re.compile(rf"[\w\-]+(?:{_DOT}[\w\-]+)*?{_DOT}[^\W\d_]{{2,}}(?![\w])(?:{_DOT}[^\W\d_]{{2,}}(?!\w))*", re.I)
_WORDS_DOMAIN = re.compile(r"[\w\-]+(?: (?:dot|точка) [\w\-]+)+", re.I)


def _emails(s: str) -> Iterator[tuple[int, int, str]]:
    for m in _AT.finditer(s):
        a, b, sign = m.start(), m.end(), m.group()
        if sign == "@" and a and s[a - 1] == " ":
            if s[b : b + 1] != " ":
                continue
            a, b = a - 1, b + 1
        elif sign == "@" and s[b : b + 1] == " ":
            continue
        elif sign != "@" and sign[0] != " ":
            a -= s[a - 1 : a] == " "
            b += s[b : b + 1] == " "
        left = _LOCAL.search(s, max(0, a - 70), a)
        right = (_WORDS_DOMAIN if sign.strip().lower() == "at" and sign[0] == " " else _DOMAIN).match(s, b)
        if left and right:
            start, end = left.start(), right.end()
            key = re.sub(r"\s?[(\[{]?\s?\b(?:dot|точка)\b\s?[)\]}]?\s?| \. ", ".", s[start:a], flags=re.I) + "@" + re.sub(r"\s?[(\[{]?\s?\b(?:dot|точка)\b\s?[)\]}]?\s?| \. ", ".", right.group(), flags=re.I)
            yield start, end, key.lower()


# --- numbers --------------------------------------------------------------------
_DIGITS = re.compile(r"[0-9][0-9 .\-()№]{4,}[0-9]")
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ .\-()№]{0,3}[0-9]){5,}(?!\w)")
_ID_WORD = re.compile(r"(паспорт|passport)|(снилс|snils)|((?<!\w)(?:инн|inn|taxpayer|tax id|tin|itin)(?!\w))|(ssn|social security)|(national insurance|ni number|nino)|(водительск\w+|загран\w*|driv\w+ licen[cs]e)")
_ID_SIGNS = ("паспорт", "passport", "снилс", "snils", "инн", "inn", "tax", "tin", "ssn", "social", "insurance", "ni number", "nino", "водительск", "загран", "licen")
_PHONE_WORD = re.compile(r"тел|моб|звон|набира|номер|контакт|phone|call|tel|ring|reach|whatsapp|text me|вечером|факс|fax|смс|sms", re.I)
_NINO = re.compile(r"[A-Za-z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-Da-d](?!\w)")
_SHAPES = re.compile(
    r"[0-9]{3}-(?:[0-9]{3}-[0-9]{3}[ \-][0-9]{2}|[0-9]{2}-[0-9]{4})(?![0-9\-])"
)
_GROUPED = re.compile(r"\(?(\d{3,5})\)?[ .\-]{0,2}(\d{2,3})[ .\-]?(\d{2})[ .\-]?(\d{2})\Z|\(?(\d{3})\)?[ .\-]{1,2}(\d{3})[ .\-](\d{4})\Z")


def _is_phone(s: str, m_text: str, digits: str, before: str) -> bool:
    n, bare = len(digits), digits == m_text
    if m_text.startswith("+"):
        return 10 <= n <= 15
    if n == 11 and digits[0] in "87" and digits[1] not in "01":
        return not bare or digits[1] in "3489" or bool(_PHONE_WORD.search(before))
    if n == 11 and digits[0] == "1" and digits[1] in "23456789":
        return not bare or bool(_PHONE_WORD.search(before)) or digits[4] in "23456789"
    if n == 10:
        if bare:
            return digits[0] in "23456789" and bool(_PHONE_WORD.search(before))
        return digits[0] in "23456789" and bool(_GROUPED.match(m_text))
    if n in (11, 12) and digits[:1] == "0" and not bare:
        return bool(_PHONE_WORD.search(before))
    return False


def _numbers(s: str, low: str) -> Iterator[tuple[str, int, int, str]]:
    taken = Spans()
    free = taken.free

    if not _DIGITS.search(s):
        return
    for m in _SHAPES.finditer(s):
        if m.start() and (s[m.start() - 1].isdigit() or s[m.start() - 1] == "-"):
            continue
        taken.add(*m.span())
        yield "id_number", *m.span(), re.sub(r"\D", "", m.group())
    for w in _ID_WORD.finditer(low) if any(x in low for x in _ID_SIGNS) else ():
        which, at = w.lastindex, w.end()
        window = s[at : at + 48]
        if which == 1:
            hit = re.match(r"\D{0,30}?(\d{2} ?\d{2}[ \-]*(?:№|no\.?|N|номер)?[ ]*\d{6})(?!\d)", window, re.I) or re.match(r"[^\n!?]{0,24}?(\b[A-Z]{1,2} ?\d{6,9})\b", window, re.I) or re.match(r"\W{0,4}(?:no\.?|number|num|#|№)?\W{0,4}(\d{8,9})(?!\d)", window, re.I)
        elif which == 2:
            hit = re.match(r"[^\d\n]{0,16}?(\d{3}[ \-.]?\d{3}[ \-.]?\d{3}[ \-.]?\d{2})(?!\d)", window)
        elif which == 3:
            hit = re.match(r"[^\d\n]{0,16}?(\d{2,4}(?:[ \-]?\d{2,4}){2,4}|\d{10}|\d{12})(?!\d)", window)
            if hit and len(re.sub(r"\D", "", hit.group(1))) not in (9, 10, 12):
                hit = None
        elif which == 4:
            hit = re.match(r"[^\d\n]{0,20}?(\d{3}[ \-.]?\d{2}[ \-.]?\d{4})(?!\d)", window)
        elif which == 5:
            hit = re.match(r"[^\n]{0,16}?\b([A-Z]{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?[A-D]?)\b", window, re.I)
        else:
            hit = re.match(r"[^\d\n]{0,24}?(\d{2} ?\d{2} ?\d{6})(?!\d)", window)
        if hit:
            a, b = at + hit.start(1), at + hit.end(1)
            if free(a, b):
                taken.add(a, b)
                yield "id_number", a, b, re.sub(r"[^0-9A-Z]", "", hit.group(1).upper())
    for m in _NINO.finditer(s):
        if free(*m.span()) and not (m.start() and s[m.start() - 1].isalnum()):
            taken.add(*m.span())
            yield "id_number", *m.span(), re.sub(r"\W", "", m.group().upper())
    for m in _NUMBER.finditer(s):
        a, b = m.span()
        if a and (s[a - 1].isalnum() or s[a - 1] == "_" or s[a - 1] == "." and s[a - 2 : a - 1].isdigit()):
            continue
        run = s[a:b]
        pieces = [(a, b)] if free(a, b) else []
        if not pieces:
            edges = taken.within(a, b)
            at = a
            for x, y in [*edges, (b, b)]:
                if x - at >= 6:
                    pieces.append((at, x))
                at = max(at, y)
        for x, y in pieces:
            while x < y and not (s[x].isdigit() or s[x] in "+("):
                x += 1
            while y > x and not s[y - 1].isdigit():
                y -= 1
            yield from _phones(s, x, y)


def _phones(s: str, a: int, b: int) -> Iterator[tuple[str, int, int, str]]:
    run = s[a:b]
    if run.startswith("(") and run.count("(") > run.count(")"):
        a, run = a + 1, run[1:]
    digits = re.sub(r"\D", "", run)
    if len(digits) < 10:
        return
    before = s[max(0, a - 40) : a]
    if _is_phone(s, run, digits, before):
        yield "phone", a, b, _phone_key(digits)
    elif len(digits) > 11 or len(digits) == 11:
        # several numbers in a row: a phone may stand inside, apart from the others
        for m in re.finditer(r"(?<!\d)(?<!\d[.\-])(?:\+?[78][ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{2}[ .\-]?\d{2}|\+?[78]\d{10}|\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{2}[ .\-]?\d{2}|\(?[2-9]\d{2}\)?[ .\-]\d{3}[ .\-]\d{4})(?![.\-]?\d)", run):
            if m.group() != run:
                yield "phone", a + m.start(), a + m.end(), _phone_key(re.sub(r"\D", "", m.group()))


def _phone_key(digits: str) -> str:
    return digits[1:] if len(digits) == 11 and digits[0] in "781" else digits


# --- addresses ------------------------------------------------------------------
_STREET = r"(?:ул(?:ица|ице|ицу|ицы)?|просп(?:ект)?(?:е|у|а)?|пр-?к?т|пр|пер(?:еул(?:ок|ке|ка)?)?|бульв?(?:ар)?(?:е|а)?|б-р|бул|ш(?:оссе)?|наб(?:ережная|ережной|ережную)?|пл(?:ощадь|ощади)?|проезд(?:е|а)?|пр-д|тупик(?:е)?|алле[яие]|линия|тракт)"
_HOUSE = r"(?:(?:д(?:ом(?:е|а|у)?)?|вл(?:адение)?|стр(?:оение)?|house|no)\b\.?\s?№?\s?)?№?\s?\d{1,4}(?!\d)(?:\s?[а-яa-z](?!\w))?"
_NAME_WORDS = r"[«\"]?(?!дом\b|д\b|в\b|на\b)[^\W\d_][\w\-]*(?:[ \-][^\W\d_][\w\-]*){0,2}?[»\"]?"
_ADDRESS_RU = (
    re.compile(rf"(?<!\w){_STREET}\b\.?\s{{0,3}}{_NAME_WORDS}[ ,;]{{1,3}}(?:в\s)?{_HOUSE}", re.I),
    re.compile(rf"(?<!\w)[^\W\d_][\w\-]+(?:ая|ой|ую|ый|ий|ого|ская|ской|ный|ном|ском|ева|ова|ина)\s{_STREET}\b\.?[ ,;]{{1,3}}(?:в\s)?{_HOUSE}", re.I),
    re.compile(r"(?<!\w)на\s[^\W\d_][\w\-]+(?:ой|ом|ем|ей)\s?,?\s(?:в\s)?дом(?:е|а|у)?\s(?:№\s?)?\d{1,4}", re.I),
    re.compile(r"(?<!\w)(?:ul|ulitsa|prospekt|pr-t|per|pereulok|bulvar|shosse|nab)\b\.?\s[^\W\d_][\w\-]+[ ,;]{1,3}(?:(?:d|dom)\b\.?\s?)?\d{1,4}", re.I),
)
_ADDRESS_EN = re.compile(r"(?<![\w.])\d{1,5}(?:-\d{1,4})?\s?[A-Z]?,?\s(?:(?:North|South|East|West|Old|New|St\.?|Upper|Lower|N|S|E|W)\.?\s)?[^\W\d_][\w'\-]*(?:\s[^\W\d_][\w'\-]*){0,2}?\s(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Court|Ct|Square|Sq|Terrace|Way|Place|Pl|Boulevard|Blvd|Crescent|Gardens|Grove|Hill|Row|Mews|Walk|Parade|Quay|Highway|Hwy|Parkway)\b", re.I)
_ADDRESS_EN2 = re.compile(r"(?<!\w)(?:[^\W\d_][\w'\-]*\s){1,2}(?:Street|Road|Avenue|Lane|Drive|Close|Court|Square|Terrace|Boulevard|Crescent|Gardens|Grove),?\s(?:no\.?\s|number\s|house\s|№\s)?\d{1,4}\b", re.I)
_EN_WORD = re.compile(r" (?:street|road|avenue|lane|drive|close|court|square|terrace|way|place|boulevard|crescent|gardens|grove|hill|row|mews|walk|parade|quay|highway|parkway|st|rd|ave|ln|dr|ct|sq|pl|blvd|hwy)\b")
_STREET_RU_AT = re.compile(r"(?<!\w)(?:ул|улиц|просп|пр-?к?т|пр-д|проезд|пер|бул|б-р|шосс|ш\.|наб|площ|пл\.|тупик|алле|линия|тракт|дом[еау] |ul[. ]|ulits|prosp|pr-t|per\.|pereul|bulv|shosse|nab\.)")


def _addresses(s: str, low: str) -> Iterator[tuple[int, int, str]]:
    last = -1
    for m in _STREET_RU_AT.finditer(low):
        if m.start() < last:
            continue
        lo = max(0, m.start() - 45)
        for i, p in enumerate(_ADDRESS_RU):
            hit = p.match(s, m.start()) if i in (0, 3) else next((x for x in p.finditer(s, lo, m.end() + 40) if x.start() <= m.start() < x.end()), None)
            if hit:
                a, b = hit.span()
                more = re.compile(r"(?:[,;/ ]{0,3}(?:корп(?:ус)?|к|стр|кв(?:артира)?|оф(?:ис)?|подъезд|под|эт(?:аж)?|лит)\b\.?\s?\d{1,4}|[/\-]\d{1,4})+", re.I).match(s, b)
                b = more.end() if more else b
                yield a, b, re.sub(r"\W+", " ", s[a:b].lower().replace("ё", "е")).strip()
                last = b
                break
    if _EN_WORD.search(low):
        for p in (_ADDRESS_EN, _ADDRESS_EN2):
            for m in p.finditer(s):
                yield *m.span(), re.sub(r"\W+", " ", m.group().lower())


# --- names ----------------------------------------------------------------------
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_SURNAME_RU = re.compile(r"(?:[оеё]в|[иы]н|[сц]к(?:ий|ой)|ич|[уюя]к|енко|ко|ян|дзе|швили|ых|их|юк|[аяе]ц|ой|ый)(?:а|у|ым|ом|е|ой|ая|ую|ого|ому|ем|я|ю|ы)?\Z|[сц]к(?:ая|ую|ого|ому|им|ом)\Z")
_INITIAL_PAIR = re.compile(r"[А-ЯЁA-Z]\.\s?[А-ЯЁA-Z]\.")
_WORD_BEFORE = re.compile(r"([^\W\d_][\w'\-]+)[ ,]{1,2}\Z")
_WORD_AFTER = re.compile(r"\s?([А-ЯЁA-Z][\w'\-]+)")
_ONE_INITIAL = re.compile(r"(?:[A-Z]\. [A-Z][a-z]|[А-ЯЁ]\. ?[А-ЯЁ][а-яё])\w+(?!\w)")
_LEADS_INITIAL = re.compile(r"(?:[,:(] ?|\b(?:is|by|to|mr|ms|dr|from|with|dear|mrs|г-н|г-жа|от|для|зовут|уважением|уважаем(?:ый|ая))\.? )\Z", re.I)
_STARTS_SENTENCE = re.compile(r"(?:^|[.!?…][\"'»)]?\s{1,3}|[\r\n]\s{0,3})\Z")
_SHORTENED = re.compile(r"(?:\b(?:ул|пр|пл|пер|наб|просп|бул|им|ст|г|пос|st|ave|rd|no|vol|fig)|(?<!\w)[^\W\d_])\.\s{0,3}\Z", re.I)
_CITIES = frozenset("азов белев гагарин жуков жуковский киров королев псков пушкин ростов саров саратов серов тамбов чехов белгород камышин боровск".split())
_CALL = re.compile(r"(?:меня зовут|зовут меня|мо[её] имя|получатель|на имя|фио|ф\. ?и\. ?о\.|с уважением|подпись|my name is|i am called|regards|sincerely|yours|name)\s?[:,\-]?\s+", re.I)
# Words that stand before a name in English letters.
_ROLES = ("agent", "assistant", "attorney", "consultant", "director", "engineer", "manager", "operator", "specialist")
_INTRODUCTIONS = ("my name is", "regards,", "sincerely,", "attn", "dear", *(f"{r}," for r in _ROLES))
_INTRODUCED = re.compile(r"\b(?:[Mm]y name is|MY NAME IS|[Rr]egards,|REGARDS,|[Ss]incerely,|" + "|".join(f"[{r[0].upper()}{r[0]}]{r[1:]}," for r in _ROLES) + r"|[Aa]ttn:?|[Dd]ear)\s(?:M(?:r|s|rs|iss)\.?\s)?([A-Z][\w'\-]+,? [A-Z][\w'\-]+)(?=[\s.,;!?]|\Z)")
_PATRONYMIC = re.compile(r"(?:[оеё]вич|[оеё]вн|ичн|инична|ovich|evich|ovn|evn|ichn)(?:а|у|ем|ом|е|ой|ы|a|u)?\Z")
_TITLE = re.compile(r"(?:mr|mrs|ms|miss|dr|sir|madam|господин|госпожа|г-н|г-жа)\Z", re.I)
_STOP = frozenset("и в на с по за из от до для не но а или что как это мы вы он она они я у к о об the a an and or is of in to for at on from with by i we you he she it they my your our this that".split())


def _fold(w: str) -> str:
    return w.lower().replace("ё", "е")


def _surname_like(w: str) -> bool:
    f = _fold(w)
    return len(f) > 3 and f not in GIVEN and f not in _STOP and not _PATRONYMIC.search(f)


def _names(s: str, low: str) -> Iterator[tuple[int, int, str]]:
    spans = Spans()
    folded = set(_TOKEN.findall(low.replace("ё", "е")))
    if not folded.isdisjoint(_GIVEN_SET):
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(s)]
        for i, (a, b, w) in enumerate(tokens):
            f = _fold(w)
            if f in GIVEN and (found := _around(s, tokens, i)):
                if spans.free(*found):
                    spans.add(*found)
    for m in _INITIAL_PAIR.finditer(s):
        if m.start() and (s[m.start() - 1].isalnum() or s[m.start() - 1] in "._"):
            continue
        options = []
        if x := _WORD_BEFORE.search(s, max(0, m.start() - 40), m.start()):
            options.append((_likeness(x.group(1)), x.start(), m.end()))
        if x := _WORD_AFTER.match(s, m.end()):
            options.append((_likeness(x.group(1)), m.start(), x.end()))
        good = max(options, key=lambda o: o[0], default=(0,))
        if good[0] and spans.free(*good[1:]):
            spans.add(*good[1:])
    for m in _ONE_INITIAL.finditer(s):
        if _is_one_initial(s, m) and spans.free(*m.span()):
            spans.add(*m.span())
    for m in _INTRODUCED.finditer(s) if any(x in low for x in _INTRODUCTIONS) else ():
        if spans.free(*m.span(1)):
            spans.add(*m.span(1))
    for a, b in zip(spans.starts, spans.ends):
        yield a, b, name_key(s[a:b])


def _is_one_initial(s: str, m: re.Match) -> bool:
    """An initial and a surname after a word that leads to a name, or at the start of a sentence or line."""
    word = _TOKEN.search(m.group(), 2).group()
    cyr = "а" <= _fold(word)[0] <= "я"
    if cyr and (_likeness(word) < 2 or m.group()[0] == "Г" and _fold(word) in _CITIES):
        return False
    lo = max(0, m.start() - 12)
    if _LEADS_INITIAL.search(s, lo, m.start()):
        return True
    return bool(_surname_like(word) and _STARTS_SENTENCE.search(s, lo, m.start()) and not _SHORTENED.search(s, lo, m.start()))


def _likeness(word: str) -> int:
    """How much a word beside initials looks like a surname: 0 not, 2 by its ending."""
    if not word[0].isupper() or not _surname_like(word) or _TITLE.match(word):
        return 0
    f = _fold(word)
    if re.search("[а-я]", f):
        return 2 if _SURNAME_RU.search(f) else 0
    return 1


def _around(s: str, tokens: list[tuple[int, int, str]], i: int) -> tuple[int, int] | None:
    """The name around a given name: surname before or after it, patronymic between, or initials."""
    a, b, w = tokens[i]
    called = bool(_CALL.search(s[max(0, a - 45) : a])) or "," in s[b : b + 1]
    lo, hi = i, i
    # patronymic after the given name
    if i + 1 < len(tokens) and s[b : tokens[i + 1][0]] == " " and _PATRONYMIC.search(_fold(tokens[i + 1][2])):
        hi = i + 1
    upper = w.isupper()
    lower = w.islower()
    after = tokens[hi + 1] if hi + 1 < len(tokens) and re.fullmatch(r" |, |\n", s[tokens[hi][1] : tokens[hi + 1][0]]) else None
    before = tokens[i - 1] if i and re.fullmatch(r" |, ", s[tokens[i - 1][1] : a]) else None

    def fits(t: tuple[int, int, str], comma: bool) -> bool:
        x = t[2]
        if not _surname_like(x) or _TITLE.match(x):
            return False
        f = _fold(x)
        cyr, lat = bool(re.search("[а-я]", f)), bool(re.search("[a-z]", f))
        same = bool(re.search("[а-яё]", w.lower())) == cyr
        if not same:
            return False
        case = x.isupper() if upper and len(w) > 1 else x.islower() if lower else x[0].isupper() and not x.isupper()
        if not case:
            return False
        if cyr:
            return bool(_SURNAME_RU.search(f))
        return True

    options = []
    if after and s[tokens[hi][1]] != "\n" and fits(after, s[tokens[hi][1]] == ","):
        comma = s[tokens[hi][1]] == ","
        if not comma:
            options.append((tokens[lo][0], after[1]))
    if before and fits(before, True):
        options.append((before[0], tokens[hi][1]))
    if len(options) == 2:
        # the side that follows an introduction, else the one with the surname ending, else after
        if _CALL.search(s[max(0, before[0] - 30) : before[0]]) and not _CALL.search(s[max(0, a - 30) : a]):
            return options[1]
        return options[0]
    if options:
        return options[0]
    m = re.compile(r" ?(?:[А-ЯЁA-Z]\. ?)([А-ЯЁA-Z][\w\-]+)").match(s, tokens[hi][1])
    if m and hi == i and _surname_like(m.group(1)):
        return a, m.end()
    return None


def _parts(text: str) -> tuple[str | None, list[str], str]:
    """Given name as spelt, initials, and surname of a name."""
    words = _TOKEN.findall(text)
    given = next((w for w in words if _fold(w) in GIVEN), None)
    rest = [w for w in words if w is not given and len(w) > 1 and not _PATRONYMIC.search(_fold(w)) and not _TITLE.match(w)]
    if given is None and len(rest) > 1:  # introduced, with a given name that no list has: it stands first, but before a comma
        given, rest = (rest[1], rest[:1]) if "," in text else (rest[0], rest[1:])
    return given, [w for w in words if len(w) == 1], max(rest, key=len) if rest else ""


def name_key(text: str) -> str:
    """Lemmas of surname and given name in Latin letters; of a name with initials the surname and ``<first initial>.``"""
    given, initials, surname = _parts(text)
    p = analyse(_fold(given) if given else None, _fold(initials[0]) if initials else "", _fold(surname), GIVEN_READINGS)
    first = latin(p.given) if p.given else latin(p.initial)[:1] + "."
    return f"{latin(p.surname)} {first}"


def _one_person(entities: list[Entity]) -> list[Entity]:
    """Names with initials take the key of the only full name of the document that they fit."""
    full: dict[str, set[str]] = {}
    for e in entities:
        if e.kind == "name" and not e.key.endswith("."):
            surname, given = e.key.split(" ", 1)
            full.setdefault(f"{surname} {given[:1]}.", set()).add(e.key)
    return [replace(e, key=next(iter(full[e.key]))) if e.kind == "name" and len(full.get(e.key, ())) == 1 else e for e in entities]


def find(text: str | None) -> list[Entity]:
    """All personal data of a text in order, without overlaps (earlier kinds win); none for null and empty."""
    if not text:
        return []
    s, offsets = plain(text)
    taken = Spans()
    out: list[Entity] = []

    def add(kind: str, a: int, b: int, key: str) -> None:
        if taken.free(a, b):
            taken.add(a, b)
            i, j = (a, b) if offsets is None else (offsets[a], offsets[b - 1] + 1)
            out.append(Entity(kind, i, j, text[i:j], key))

    low = lowered(s)
    if any(x in low for x in _MAIL_SIGNS):
        for a, b, key in _emails(s):
            add("email", a, b, key)
    numbers = list(_numbers(s, low))
    for kind, a, b, key in numbers:
        if kind == "id_number":
            add(kind, a, b, key)
    for a, b, key in _addresses(s, low):
        add("address", a, b, key)
    for kind, a, b, key in numbers:
        if kind == "phone":
            add(kind, a, b, key)
    for a, b, key in _names(s, low):
        add("name", a, b, key)
    return _one_person(sorted(out, key=lambda e: e.start))


# --- replacement ----------------------------------------------------------------
_SYLLABLES = {"cyr": ("бвгдзклмнпрст", "аоуеи"), "lat": ("bdfgklmnprstv", "aouei")}
SYLLABLES = 3  #: of a made-up word, before any that tell clashing ones apart
ROUNDS = 8


def identity(secret: bytes, kind: str, key: str) -> int:
    """The 128-bit number a surrogate is made from: keyed, so it cannot be traced back without the secret."""
    return int.from_bytes(hmac.new(secret, f"{kind}\0{key}".encode(), hashlib.sha256).digest()[:16], "big")


def permuted(secret: bytes, kind: str, digits: str) -> str:
    """Other digits of the same number, by a keyed permutation (a Feistel network): different digits stay different."""
    m = len(digits)
    u = m // 2
    a, b, sizes = int(digits[:u] or 0), int(digits[u:] or 0), (10**u, 10 ** (m - u))
    for i in range(ROUNDS):
        if i % 2:
            b = (b + identity(secret, f"{kind}{m}.{i}", str(a))) % sizes[1]
        else:
            a = (a + identity(secret, f"{kind}{m}.{i}", str(b))) % sizes[0]
    return (f"{a:0{u}d}" if u else "") + f"{b:0{m - u}d}"


def _word(n: int, script: str, syllables: int, rank: int = 0) -> str:
    """A made-up word; ``rank`` adds syllables that tell words of one number apart."""
    c, v = _SYLLABLES[script]
    out, size = "", len(c) * len(v)
    for _ in range(syllables):
        n, i = divmod(n, size)
        out += c[i % len(c)] + v[i // len(c)]
    while rank:
        rank, i = divmod(rank - 1, size)
        out += c[i % len(c)] + v[i // len(c)]
    return out


def _as(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def _number(e: Entity, secret: bytes, keep: int) -> str:
    """The text with its digits permuted but for the first ``keep``, and its letters shifted."""
    digits = re.sub("[^0-9]", "", e.text)
    new = iter(digits[:keep] + permuted(secret, e.kind, digits[keep:]))
    shift, out = identity(secret, e.kind, "letters"), []
    for c in e.text:
        if c.isdigit():
            c = next(new)
        elif c.isascii() and c.isalpha():
            shift, s = divmod(shift, 26)
            c = _as(c, chr(97 + (ord(c.lower()) - 97 + 1 + s % 25) % 26))
        out.append(c)
    return "".join(out)


def _name(e: Entity, n: int, syllables: int, rank: int) -> str:
    """Another name in the form of this one: same gender, case, order, initials and upper case."""
    given, initials, surname = _parts(e.text)
    p = analyse(_fold(given) if given else None, _fold(initials[0]) if initials else "", _fold(surname), GIVEN_READINGS)
    pool_ru, pool_en = GIVEN_RU_F if p.gender == "f" else GIVEN_RU_M, [x for x in GIVEN_EN if GIVEN.get(x) == ("f" if p.gender == "f" else "m")]
    name = (n >> 64) % (1 << 30)
    russian = pool_ru[name % len(pool_ru)].replace("ё", "е")
    out, at = "", 0
    for m in _TOKEN.finditer(e.text):
        w = m.group()
        f = _fold(w)
        cyr = bool(re.search("[а-я]", f))
        if len(f) == 1:  # the first initial is that of the given name, whether it is spelt out or not
            new = (russian if cyr else latin(russian))[0] if initials and w == initials[0] else _SYLLABLES["cyr" if cyr else "lat"][0][(n >> 100) % 13]
        elif given is not None and w == given:
            known_ru = any(x[0] == p.given for x in GIVEN_READINGS.get(f, ()))
            new = given_forms(russian)[p.case] if cyr else latin(russian) if known_ru else pool_en[name % len(pool_en)]
        elif _PATRONYMIC.search(f):
            stem = GIVEN_RU_M[(n >> 40) % len(GIVEN_RU_M)].replace("ё", "е").rstrip("ьйая")
            new = stem + ("овн" + ("а", "ы", "е", "у", "ой", "е")[p.case] if p.gender == "f" else "ович" + ("", "а", "у", "а", "ем", "е")[p.case])
            new = new if cyr else latin(new)
        elif _TITLE.match(w):
            new = w
        elif cyr:
            word = _word(n, "cyr", syllables, rank)
            new = surname_form(word + {"ov": "нов", "sky": "нский", "noun": "нич"}.get(p.kind, "нко"), p.kind, p.gender, p.case)
        else:
            end = _LATIN_END.search(f)
            new = latin(_word(n, "cyr", syllables, rank)) + ("n" + end.group() if end else "")
        out, at = out + e.text[at : m.start()] + _as(w, new), m.end()
    return out + e.text[at:]


_LATIN_END = re.compile(r"(?:skiy|sky|skaya|ova|eva|ina|ov|ev|in|ich|uk|enko|ton|by|wick|sen|mar|ley|ford)\Z")
_HOUSE_WORD = re.compile(r"дом\w?|корп\w*|квартира|офис|подъезд|street|road|avenue|lane|drive|close|court|square|terrace|boulevard|crescent|gardens|grove|flat|house|\w{1,3}")


def surrogate(e: Entity, secret: bytes, syllables: int = SYLLABLES, rank: int = 0) -> str:
    """What stands in for ``e``: same kind, script, case, gender and format.

    Made from the key, so spellings of one entity agree.  ``rank`` tells apart
    entities whose words would be the same.
    """
    if e.kind == "phone":
        return _number(e, secret, max(0, len(re.sub("[^0-9]", "", e.text)) - 9))
    if e.kind == "id_number":
        return _number(e, secret, 0)
    n = identity(secret, e.kind, e.key)
    if e.kind == "name":
        return _name(e, n, syllables, rank)
    if e.kind == "email":
        script = "cyr" if re.search("[а-яё]", e.text, re.I) else "lat"
        words = re.findall(r"[^\W_]+", e.text)
        signs = {"at", "dot", "собака", "собачка", "точка", "эт", "гав"}
        out, at, k = "", 0, 0
        for m in re.finditer(r"[^\W_]+", e.text):
            w, k = m.group(), k + 1
            if w.lower() not in signs and k < len(words):
                w = _as(w, _word(n >> (16 * k), script, syllables, rank if k == 1 else 0))
            out, at = out + e.text[at : m.start()] + w, m.end()
        return out + e.text[at:]
    out, at, first = "", 0, True
    for m in re.finditer(r"[^\W\d_]+(?:-[^\W\d_]+)*|\d+", e.text):
        w = m.group()
        f = _fold(w)
        new = str(1 + n % 199) if w.isdigit() else w
        if not w.isdigit() and not re.fullmatch(_STREET, f) and not _HOUSE_WORD.fullmatch(f):
            end = re.search(r"(?:ая|ой|ую|ый|ий|ом|ем|а|ого)\Z", f)
            new = _as(w, _word(n >> 8, "cyr" if re.search("[а-яё]", f) else "lat", syllables, rank if first else 0) + ("н" + end.group() if end else ""))
            first = False
        out, at = out + e.text[at : m.start()] + new, m.end()
    return out + e.text[at:]


def placeholders(entities: list[Entity]) -> list[str]:
    """``[KIND_i]`` for each entity; the same number for the same key, counted by kind in order of appearance."""
    seen: dict[tuple[str, str], int] = {}
    count: dict[str, int] = {}
    out = []
    for e in entities:
        if (e.kind, e.key) not in seen:
            count[e.kind] = count.get(e.kind, 0) + 1
            seen[e.kind, e.key] = count[e.kind]
        out.append(f"[{e.kind.upper()}_{seen[e.kind, e.key]}]")
    return out


Ranks = dict[tuple[str, str], int]


def canonical(e: Entity, secret: bytes, syllables: int = SYLLABLES, rank: int = 0) -> str:
    """What two entities must not share, whatever case or format they are spelt in: the words, or the digits, of the surrogate."""
    if e.kind in ("phone", "id_number"):
        return "".join(c for c in surrogate(e, secret).upper() if c.isalnum())[-9 if e.kind == "phone" else 0 :]
    n = identity(secret, e.kind, e.key)
    return f"{_word(n >> {'name': 0, 'address': 8, 'email': 16}[e.kind], 'lat', syllables, rank)} {n % 199 if e.kind == 'address' else ''}".strip()


def surrogates(entities: list[Entity], secret: bytes, ranks: Ranks | None = None, syllables: int = SYLLABLES) -> list[str]:
    """A surrogate for each entity of a document; different keys of a kind never share their words.

    ``ranks`` tells those of a whole collection apart (:func:`clashes`); others
    of the document are told apart here, with as many attempts as it takes.
    """
    ranks, taken, own, out = ranks or {}, {}, {}, []
    for e in entities:
        key = (e.kind, e.key)
        if key not in own:
            for rank in count(ranks.get(key, 0)):
                shown = (e.kind, canonical(e, secret, syllables, rank))
                if e.kind in ("phone", "id_number") or taken.setdefault(shown, e.key) == e.key:
                    break
            own[key] = rank
        out.append(surrogate(e, secret, syllables, own[key]))
    return out


def rewrite(text: str | None, entities: list[Entity], new: list[str]) -> str | None:
    """The text with each entity replaced; everything else stays, to the character."""
    if not text:
        return text
    out, at = [], 0
    for e, x in zip(entities, new):
        out += [text[at : e.start], x]
        at = e.end
    return "".join([*out, text[at:]])


def _entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))


def replacements(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", secret: str | None = None, ranks: Ranks | None = None, syllables: int = SYLLABLES) -> DataFrame:
    """``id, kind, start, end, text, key, placeholder, surrogate, words``: one row for each entity of each row.

    Offsets count characters of the text as given.  ``surrogate`` and ``words``
    (what different entities must not share) are null without a ``secret``.  Null
    and empty texts have no rows; repeated rows are treated each; an empty table
    gives an empty result.  One narrow pass over two columns, no shuffle.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL("kind string, start int, end int, text string, key string, placeholder string, surrogate string, words string").fields])
    key = None if secret is None else secret.encode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"]):
                if es := find(text):
                    new = [None] * len(es) if key is None else surrogates(es, key, ranks, syllables)
                    words = [None if key is None else canonical(e, key, syllables, (ranks or {}).get((e.kind, e.key), 0)) for e in es]
                    rows += [(i, e.kind, e.start, e.end, e.text, e.key, p, x, w) for e, p, x, w in zip(es, placeholders(es), new, words)]
            yield pd.DataFrame(rows, columns=schema.names)

    return _entities(df, id_col, text_col).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def masked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", secret: str | None = None, ranks: Ranks | None = None, syllables: int = SYLLABLES) -> DataFrame:
    """``id, masked, n_found`` for every row: typed placeholders, or surrogates where ``secret`` is given.

    Null stays null and empty stays empty, with ``n_found`` 0.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("masked", T.StringType()), T.StructField("n_found", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find(t) for t in b["text"]]
            new = [placeholders(es) if secret is None else surrogates(es, secret.encode(), ranks, syllables) for es in found]
            yield pd.DataFrame({"id": b["id"], "masked": [rewrite(t, es, x) for t, es, x in zip(b["text"], found, new)], "n_found": pd.Series([len(x) for x in found], dtype="int32")})

    return _entities(df, id_col, text_col).mapInPandas(run, schema).withColumnRenamed("id", id_col)


MAX_CLASHES = 100_000  #: entities with a rank; with more, all words get a syllable more


def clashes(df: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[Ranks, int]:
    """(ranks, syllables) under which no two entities of the collection share a surrogate's words.

    Entities are reduced to distinct keys and grouped by their words; the keys of
    a group are ranked by a keyed order.  A ranked word is longer than all
    unranked ones, and begins with its group's, so ranks clash with nothing.
    """
    entities = materialise(replacements(df, id_col, text_col, secret).select("kind", "key").distinct())
    for syllables in count(SYLLABLES):

        def word(batches: Iterator[pd.DataFrame], syllables=syllables) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(words=[canonical(Entity(k, 0, 0, x, x), secret.encode(), syllables) for k, x in zip(b["kind"], b["key"])])

        # numbers are permuted and cannot clash
        worded = entities.where("kind NOT IN ('phone', 'id_number')").mapInPandas(word, "kind string, key string, words string")
        order = F.sha2(F.concat(F.lit(secret), "key"), 256)
        shared = worded.groupBy("kind", "words").agg(F.count("*").alias("n")).where("n > 1").select("kind", "words")
        place = F.row_number().over(Window.partitionBy("kind", "words").orderBy(order, "key")) - 1
        got = worded.join(shared, ["kind", "words"]).withColumn("rank", place).where("rank > 0").select("kind", "key", "rank").limit(MAX_CLASHES + 1).collect()
        if len(got) <= MAX_CLASHES:
            return {(r["kind"], r["key"]): r["rank"] for r in got}, syllables


def collisions(found: DataFrame) -> DataFrame:
    """``kind, words, n_keys``: words of surrogates that stand for several people or places in the whole collection.

    ``found`` comes from :func:`replacements` with a secret.  Entities are reduced
    to distinct keys before they are grouped, so frequent ones cost nothing.
    Numbers are permuted and cannot collide.
    """
    words = found.where("kind NOT IN ('phone', 'id_number')").select("kind", "key", "words")
    return words.distinct().groupBy("kind", "words").agg(F.count("*").alias("n_keys")).where("n_keys > 1")
