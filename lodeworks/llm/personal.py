"""Personal data in running text: found, replaced by typed placeholders or by surrogates.

Texts are read in the form of ``forms`` (so that spellings with odd characters are read
as a reader would) and every finding is carried back to its place in the text as stored,
which stays unchanged elsewhere. Kinds: email, phone, id_number, address, name.

Names are found from an incomplete list of parts, extended by the corpus: a word that
keeps standing before listed family names is taken for a given name, one that stands
after a given name for a family name.

Surrogates are keyed and keep type, format, script and, for listed given names, the gender
that titles and pronouns of the corpus tell: listed parts trade places within their class
by a keyed permutation, all else is enciphered place by place within its character class
(script, vowel or not, accented or not) by a keyed Feistel network; of mail domains only
those of public services stay. Both are one-to-one and leave nothing as it was, so equal
entities get equal surrogates and different ones different ones; ``collisions`` checks
that over a whole table.

Null texts stay null and hold nothing, as do empty and blank ones; repeated rows come
back as often as they went in; columns not named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm import forms
from lodeworks.runtime import Stage

KINDS = ("email", "phone", "id_number", "address", "name")
#: Name parts that go to every worker: of listed ones, the most there may be; learned ones beyond it are joined to the texts.
MAX_PARTS = 200_000
#: Share of a word's capitalised uses that must stand before a family name, to be a given name.
GIVEN_SHARE = 0.05
#: The same for standing after a given name, to be a family name.
FAMILY_SHARE = 0.2

#: Characters of a line from which its end may be a wrap inside a sentence.
WRAPPED = 56

_I = re.IGNORECASE
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?)"
_LOCAL = r"(?<![\w.+%-])[A-Za-z0-9](?:[\w.+%-]*[\w+])?"
EMAILS = (
    re.compile(rf"{_LOCAL}{_AT}[A-Za-z0-9][\w-]*(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w-])", _I),
    re.compile(rf"{_LOCAL}\s+at\s+[A-Za-z0-9][\w-]*(?:(?:\s+dot\s+|\.)[\w-]+)*\s+dot\s+[A-Za-z]{{2,}}(?![\w-])", _I),
)
_AT_SIGN = re.compile(r"@|[\[({<]\s?[aA][tT]\s?[\])}>]|\s(?:at|AT|At)\s(?=[^\n]{0,80}\s(?:dot|DOT|Dot)\s)")

def _at_written(low: str) -> bool:
    """Whether a lower-cased text may hold an address whose signs are written out."""
    return (
        " dot " in low or "at]" in low or "at)" in low or "at>" in low or "at}" in low
        or "at ]" in low or "at )" in low or "at >" in low or "at }" in low
    )


_URL = re.compile(r"\b(?:https?|ftp)://\S+|\bwww\.\S+", _I)
_NUMBER = re.compile(r"(?<![\w.@#%-])(?:\+|\()?\d(?:\d|[ \t\n()/-]|\.(?=\d)){4,}\d(?![\w@%]|[-./]\w)")
_NOT_PERSONAL = re.compile(r"(?:order|ref(?:erence)?|version|batch|serial|invoice|catalogue|isbn|issn|checkpoint|string|ratio|score|part|model|lot|sku|server|ip|id=|limit=|offset|checksum|build|release|ticket|tracking|account|item|article|step)\W*(?:no\.?|number|nr\.?|ref|#|:)?\W*$", _I)
_CALLED = re.compile(r"(?:tel|phone|call|ring|rang|whatsapp|mobile|cell|fax|sms|téléphone|telefon|dial|line in \w+ is|reached|caller left)\W*(?:no\.?|number|at|on|us|:)?\W*$", _I)
# The shapes of phone numbers.
PHONES = re.compile(
    r"\+\d{1,3}[ ./-]?(?:\(0\)[ ./-]?)?\d[\d ./()-]{5,16}\d"
    r"|00[1-9]\d{0,2}[ ./-]\d[\d ./()-]{6,14}\d"
    r"|(?:1[ .-])?\([2-9]\d{2}\)[ .-]?\d{3}[ .-]?\d{4}|(?:1[ .-])?[2-9]\d{2}([ .-])\d{3}\1\d{4}"
    r"|0[1-9](?:([ .-])\d{2})(?:\2\d{2}){3}"
    r"|0\d{2,4} ?[/-] ?\d{3,8}(?: \d{2,5})?|0\d{2,4} \d{3,4} \d{3,4}|0\d{3,4} \d{5,7}|0[1-9]\d{8,9}"
    r"|[6-9]\d{4}[ -]\d{5}"
)
# The shapes of identity numbers that need no label.
BARE_IDS = re.compile(r"\d{3}([ -])\d{2}\1\d{4}|\d{4}[ -]\d{4}[ -]\d{4}")
_ALONE = re.compile(rf"(?<!\S)(?:{BARE_IDS.pattern})(?!\S)")
_PLAIN_ID = re.compile(r"(?<![\w-])[A-Z]{2}-\d{3}-\d{4}(?![\w-])|(?<![\w-])[A-Z]{5}\d{4}[A-Z](?![\w-])")
_LABELLED = re.compile(
    r"(?:passport|identity card|id card|national id(?:entity)?|citizen(?:ship)?|tax id|tax|social security|ssn|personal id|aadhaar|pan|driver'?s? licen[cs]e|insurance)"
    r"(?:\s+(?:card|number|no\.?|nr\.?|id|code))*\s*[:#]?\s*((?=[A-Z0-9 -]*\d)[A-Z0-9](?:[A-Z0-9]|[ -](?=[A-Z]{0,3}\d)){5,18})(?![\w])",
    _I,
)

# Street words, after the name (English), joined to it (German), before it (French).
STREETS = "Street St Road Rd Lane Ln Terrace Avenue Ave Close Row Drive Dr Way Court Ct Gate Place Square Crescent Boulevard Blvd Nagar Marg Gardens Grove Hill Park Mews Parade Quay Walk".split()
_UNIT = r"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|House|No\.)\s+\d+[A-Za-z]?\s*,\s*)?"
_PART = r"[A-ZÀ-Þ][\w'’-]*"
_TOWN = rf"(?:\s*,\s*(?:\d{{4,6}}\s+)?{_PART}(?:\s+\d{{4,6}}\b)?)?"
ADDRESSES = (
    rf"{_UNIT}(?<![\w.-])\d{{1,4}}[a-z]?(?:[-–/]\d{{1,4}}[a-z]?)?,?\s+(?:{_PART}\s+){{1,3}}(?:{'|'.join(STREETS)})\b\.?{_TOWN}",
    rf"(?<![\w-])[A-ZÀ-Þ][\wÀ-ÿ-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer)\s+\d{{1,4}}[a-z]?(?![\w.-]*\w)(?:\s*,\s*\d{{4,5}}\s+{_PART})?",
    rf"{_UNIT}(?<![\w.-])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours)\s+(?:de\s+la\s+|de\s+l['’]|des\s+|du\s+|de\s+|d['’])?{_PART}(?:\s*,\s*\d{{4,5}}\s+{_PART})?",
    rf"\bNo\.\s*\d{{1,4}}[A-Za-z]?\s*,\s*\d{{1,3}}(?:st|nd|rd|th)\s+(?:Cross|Main|Street|Floor)\s*,\s*(?:{_PART}\s+){{1,3}}(?:Nagar|Layout|Colony|Road|Street|Marg|Extension){_TOWN}",
)
_ADDRESSES = tuple(re.compile(p) for p in ADDRESSES)
_ADDRESSES_ANY = tuple(re.compile(p, _I) for p in ADDRESSES)
# Cheap signs, one for each pattern of ADDRESSES, without which it is not tried.
_SIGNS = (
    (None, re.compile(r"\d[a-z]?,?\s+[A-ZÀ-Þ]").search),
    (lambda t: "straße" in t or "strasse" in t or "str." in t or "weg" in t or "gasse" in t or "platz" in t or "allee" in t or "ring " in t or "ring\n" in t or "damm" in t or "ufer" in t, re.compile(r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer)\s+\d").search),
    (
        lambda t: "rue" in t or "avenue" in t or "boulevard" in t or "place" in t or "chemin" in t or "allée" in t or "impasse" in t or "quai" in t or "route" in t or "cours" in t,
        re.compile(r"\d(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours)\s").search,
    ),
    (lambda t: "Cross" in t or "Main" in t or "Street" in t or "Floor" in t, re.compile(r"\d(?:st|nd|rd|th)\s+(?:Cross|Main|Street|Floor)").search),
)
_ID_SIGN = re.compile(r"\d{3}(?:(?<=[A-Z]\d{3})|(?<=[A-Z]-\d{3})|\d{6})").search
_DIGIT = re.compile(r"\d").search
_LONG_NUMBER = re.compile(r"\d[\d \t\n()/.-]{4,}\d").search
_LOWER = re.compile("[a-z]").search

# Forms of address that stand before a family name.
TITLES = "Dr Mr Mrs Ms Miss Prof Professor Sir Herr Frau Mme Mlle Monsieur Madame Shri Smt Sri Don Señor Señora".split()
_TITLE_WORDS = frozenset(TITLES)
_TITLE = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.?\s+(?:[A-ZÀ-Þ]\.\s*){0,2}$", _I)
_TITLED = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.?\s+(?:[A-ZÀ-Þ]\.\s*){0,2}([A-ZÀ-Þ][^\W\d_]{2,}(?:-[A-ZÀ-Þ][^\W\d_]+)*)")
# Vowel signs and the like, which are no letters to the patterns: Indic blocks of 128, Arabic and Hebrew points.
_SIGNS_OF_WORDS = "".join(chr(c) for a, b in ((0x300, 0x370), (0x591, 0x5C8), (0x610, 0x660), (0x900, 0xD80)) for c in range(a, b) if unicodedata.category(chr(c))[0] == "M")
_LETTER = rf"(?:[^\W\d_]|[{_SIGNS_OF_WORDS}])"
_WORD = re.compile(rf"[^\W\d_]{_LETTER}*")
#: Capitals of the scripts that have them, and any letter of those that have not (Indic, Arabic, Hebrew).
_CAPITAL_LATIN = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:['’-][^\W\d_]+)*")
_CAPITAL = re.compile(rf"{_CAPITAL_LATIN.pattern}|[Ā-ƿ\u0386-\u03AB\u0400-\u042F]{_LETTER}+(?:['’-]{_LETTER}+)*|[\u0904-\u0939\u0958-\u0961\u0985-\u0D7F\u05D0-\u05EA\u0620-\u064A]{_LETTER}+")
_ANY_WORD = re.compile(rf"[^\W\d_]{_LETTER}+(?:['’-]{_LETTER}+)*")
_BEYOND_LATIN = re.compile("[\u0100-\u01BF\u0370-\u1FFF]").search


def _capitals(text: str) -> re.Pattern:
    """The pattern of capitalised words that ``text`` needs."""
    return _CAPITAL_LATIN if text.isascii() or not _BEYOND_LATIN(text) else _CAPITAL


_GAP = re.compile(r"\s+(?:[A-Za-zÀ-Þ]\.\s*)?$")
_BODY = re.compile(r"\s+(?:Foundation|Trust|Press|Institute|University|College|School|Company|Co|Ltd|Inc|GmbH|Group|Society|Museum|Library|Hall|Bridge|Fund|Prize|Award|Bank|Works|Mills?|" + "|".join(s for s in STREETS if len(s) > 2) + r")\b", _I)
_NO_GIVEN = frozenset("the in by at on for to of and or a an from with near since before after while because although but so when if as is was were during earlier hence therefore assume suppose given step this that each every no not call said via der die das ein eine le la les un une selon laut nach".split())


@functools.cache
def _script(char: str) -> str:
    return unicodedata.name(char, "OTHER").split()[0]


class Parts:
    """Given and family names, in lower case: listed, and learned from the corpus."""

    def __init__(self, given: set[str], family: set[str], learned_given: set[str], learned_family: set[str], sure: set[str]):
        self.given, self.family = given | learned_given, family | learned_family
        self.listed_given, self.listed_family, self.sure = given, family, sure
        self.hot = self.given | self.family

    @classmethod
    def held(cls, marks: dict[str, int]) -> Parts:
        """The parts that a single text holds, from their marks."""
        of = lambda bit: {w for w, m in marks.items() if m & bit}
        return cls(of(1), of(2), of(4), of(8), of(16))

    def is_family(self, word: str) -> bool:
        return any(p in self.family for p in word.casefold().split("-"))


def _spans(found: list[tuple[int, int, str]], start: int, end: int, kind: str) -> None:
    if all(end <= a or start >= b for a, b, _ in found):
        found.append((start, end, kind))


def _one_case(text: str, low: str | None = None) -> bool:
    return text == (text.lower() if low is None else low) or not _LOWER(text) and text == text.upper()


def findings(text: str, parts: Parts) -> list[tuple[int, int, str]]:
    """Spans and kinds of the personal data in ``text``, in order, none overlapping."""
    taken: list[tuple[int, int, str]] = []
    low = text.lower()
    if "://" in low or "www." in low:
        taken += [(m.start(), m.end(), "url") for m in _URL.finditer(text)]
    if "@" in text or _at_written(low):
        for at in _AT_SIGN.finditer(text):
            for pattern in EMAILS:
                for m in pattern.finditer(text, max(0, at.start() - 80), at.end() + 120):
                    if m.start() < at.start() and m.end() > at.end():
                        _spans(taken, m.start(), m.end(), "email")
    plain = _one_case(text, low)
    if _DIGIT(text):  # all of these need one
        if plain or _ID_SIGN(text):
            for m in _LABELLED.finditer(text):
                if sum(map(str.isdigit, m[1])) >= 4:
                    _spans(taken, m.start(1), m.end(1), "id_number")
            for m in _PLAIN_ID.finditer(text):
                _spans(taken, m.start(), m.end(), "id_number")
        for n, (hint, sign) in enumerate(_SIGNS):
            if plain or (hint is None or hint(text)) and sign(text):
                for m in (_ADDRESSES_ANY if plain else _ADDRESSES)[n].finditer(text):
                    _spans(taken, m.start(), m.end(), "address")
        if _LONG_NUMBER(text):
            for m in _NUMBER.finditer(text):
                _numbers(text, m.start(), m[0], taken)
    _names(text, parts, taken, plain)
    return sorted(f for f in taken if f[2] != "url" and not _broken(text, f[0], f[1]))


def _broken(text: str, start: int, end: int) -> bool:
    """Whether the span runs over the end of a line that is too short to have been wrapped."""
    at = text.find("\n", start, end)
    return at >= 0 and at - text.rfind("\n", 0, at) - 1 < WRAPPED


def _numbers(text: str, at: int, run: str, taken: list[tuple[int, int, str]]) -> None:
    digits = sum(map(str.isdigit, run))
    if not 7 <= digits:
        return
    before = text[max(0, at - 32) : at]
    if _NOT_PERSONAL.search(before) and not run.startswith("+"):
        return
    flat = re.sub(r"\s", " ", run)
    if m := _ALONE.search(flat):
        _spans(taken, at + m.start(), at + m.end(), "id_number")
        return
    m = PHONES.match(flat)
    if m and 7 <= sum(map(str.isdigit, m[0])) <= 15 and (m.end() == len(flat) or flat[m.end()] in " \t"):
        _spans(taken, at + m.start(), at + m.end(), "phone")
        return
    m = PHONES.search(flat)
    if m and m.start() and flat[m.start() - 1] == " " and (m.end() == len(flat) or flat[m.end()] == " ") and 9 <= sum(map(str.isdigit, m[0])) <= 15:
        _spans(taken, at + m.start(), at + m.end(), "phone")
    elif 7 <= digits <= 13 and _CALLED.search(before) and not re.search(r"\d\.\d", flat):
        _spans(taken, at, at + len(run), "phone")


def _names(text: str, parts: Parts, taken: list[tuple[int, int, str]], plain: bool) -> None:
    pattern = _ANY_WORD if plain else _capitals(text)
    found = set(pattern.findall(text))
    titled = not plain and not _TITLE_WORDS.isdisjoint(found)
    if not titled and parts.hot.isdisjoint(map(str.casefold, found)):
        return
    words = [(m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    given, sure = parts.given, parts.sure
    for i, (s, e, w) in enumerate(words):
        key = w.casefold()
        after = words[i + 1] if i + 1 < len(words) else None
        if after and (key in given or key.split("-")[0] in given) and _GAP.match(text[e : after[0]]):
            family = parts.is_family(after[2])
            loud = w.isupper() or after[2].isupper()
            if family or (key in sure and not plain and not loud and after[2].casefold() not in _NO_GIVEN and len(after[2]) > 2 and after[2].casefold() not in given):
                if not _BODY.match(text[after[1] : after[1] + 16]):
                    start = s
                    if t := _TITLE.search(text[max(0, s - 14) : s]):
                        start = max(0, s - 14) + t.start()
                    _spans(taken, start, after[1], "name")
                continue
        if parts.is_family(w):
            low = max(0, s - 20)
            if (t := _TITLE.search(text[low:s])) and not _BODY.match(text[e : e + 16]):
                _spans(taken, low + t.start(), e, "name")
            elif after and after[2].casefold() in given and re.fullmatch(r",\s+", text[e : after[0]]) and (after[2].casefold() in sure or not plain) and not re.match(r"\s+[A-ZÀ-Þ]", text[after[1] : after[1] + 3]) and after[2].casefold() in parts.listed_given and key in parts.listed_family:
                _spans(taken, s, after[1], "name")
    if titled:
        for m in _TITLED.finditer(text):
            if m[1].casefold() not in _NO_GIVEN and not _BODY.match(text[m.end() : m.end() + 16]):
                _spans(taken, m.start(), m.end(), "name")


# -- learning the parts ----------------------------------------------------------------------

_SEEN = "word string, n long, before long, after long"


def _seen(known, listed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings, (given, family) = known.value, listed.value
        n: Counter = Counter()
        before: Counter = Counter()
        after: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(n)
            rows = [[*keys], [n[k] for k in keys], [before[k] for k in keys], [after[k] for k in keys]]
            for c in (n, before, after):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(r, pa.int64()) for r in rows[1:])], names=["word", "n", "before", "after"])

        for batch in batches:
            for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not t:
                    continue
                t = forms.form(t, readings, forms.plain(f))
                pattern = _capitals(t)
                capitals = [w.casefold() for w in pattern.findall(t)]
                n.update(capitals)
                if family.isdisjoint(p for w in capitals for p in w.split("-")) and given.isdisjoint(capitals):
                    continue
                last, end = "", -9
                for m in pattern.finditer(t):
                    w = m[0].casefold()
                    if last and m.start() - end <= 6 and _GAP.match(t[end : m.start()]) and _script(last[0]) == _script(w[0]):
                        if any(p in family for p in w.split("-")):
                            before[last] += 1
                        if last in given:
                            after[w] += 1
                    last, end = w, m.end()
            if len(n) > 200_000:
                yield out()
        yield out()

    return run


def _telling(seen: str, share: float):
    return F.col(seen) >= F.greatest(F.lit(1), share * F.col("n"))


def learned(source: DataFrame, known, names: DataFrame, max_parts: int = MAX_PARTS) -> tuple[DataFrame, Parts]:
    """``source`` with a column ``marks``, and name parts: the listed ones and those that the corpus adds.

    Up to ``max_parts`` words that tell of names, all parts are returned and ``marks`` is null.
    Of more, the returned parts are the listed ones and ``marks`` has all parts that a text
    holds, listed and learned, for ``Parts.held``. More listed parts than that are an error.
    """
    spark = source.sparkSession
    rows = names.where(F.col("name_part").isNotNull()).select(F.lower("name_part").alias("w"), "kind").distinct().limit(max_parts + 1).collect()
    if len(rows) > max_parts:
        raise ValueError(f"more than {max_parts} listed name parts; raise max_parts")
    given, family = ({r["w"] for r in rows if r["kind"] == k} for k in ("given", "family"))
    listed = spark.sparkContext.broadcast((given, family))
    counts = source.mapInArrow(_seen(known, listed), _SEEN).groupBy("word").agg(F.sum("n").alias("n"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    own = F.broadcast(spark.createDataFrame([(w, w in given, w in family) for w in sorted(given | family)], "word string, given boolean, family boolean"))
    told = counts.join(own, "word", "left").fillna(False, ["given", "family"]).where(_telling("before", GIVEN_SHARE) | _telling("after", FAMILY_SHARE) | F.col("given"))
    stage = Stage(spark, "parts")
    met = stage.keep(told, "met")
    if met.count() > max_parts:
        return _marked(source, known, met, own), Parts(given, family, set(), set(), set())
    met = met.collect()
    stage.drop()
    ok = lambda w: w not in _NO_GIVEN and len(w) > 1 and w.upper() not in {t.upper() for t in TITLES}
    more_given = {r["word"] for r in met if r["before"] >= max(1, GIVEN_SHARE * r["n"]) and ok(r["word"]) and r["word"] not in family}
    more_family = {p for r in met if r["after"] >= max(1, FAMILY_SHARE * r["n"]) and ok(r["word"]) for p in r["word"].split("-") if p not in given and p not in more_given and len(p) > 3}
    share = {r["word"]: r["before"] / r["n"] for r in met}
    sure = {w for w in given | more_given if share.get(w, 1.0) >= 0.3}
    return source.withColumn("marks", F.lit(None).cast(_MARKS)), Parts(given, family, more_given, more_family, sure)


_MARKS = "map<string,int>"


def _asked(known):
    """The words of each text, and their pieces between hyphens, as names are looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings = known.value
        for batch in batches:
            at, words = [], []
            for a, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fixes, held = forms.plain(f), set()
                for read in {forms.form(t, readings, fixes), mapped(t, readings, fixes)[0]}:
                    held.update(w.casefold() for w in (_ANY_WORD if _one_case(read) else _capitals(read)).findall(read))
                held.update([p for w in held for p in w.split("-")])
                at += [a] * len(held)
                words += held
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words, pa.string())], names=["at", "word"])

    return run


def _marked(source: DataFrame, known, met: DataFrame, own: DataFrame) -> DataFrame:
    """``source`` with the parts that each text holds, by joins; the rules are those of ``learned``."""
    ok = ~F.col("word").isin(*_NO_GIVEN) & (F.length("word") > 1) & ~F.upper("word").isin(*(t.upper() for t in TITLES))
    more = _telling("before", GIVEN_SHARE) & ok & ~F.col("family")
    rated = met.select("word", more.alias("more_given"), ((F.col("given") | more) & (F.col("before") / F.col("n") >= 0.3)).alias("sure"))
    pieces = met.where(_telling("after", FAMILY_SHARE) & ok).select(F.explode(F.split("word", "-")).alias("word")).where(F.length("word") > 3).distinct()
    barred = own.where("given").select("word").union(rated.where("more_given").select("word"))
    more_family = pieces.join(barred, "word", "left_anti").withColumn("more_family", F.lit(True))
    every = rated.join(more_family, "word", "full").join(own, "word", "full").withColumn("sure", F.coalesce("sure", "given"))
    bits = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) * bit for c, bit in (("given", 1), ("family", 2), ("more_given", 4), ("more_family", 8), ("sure", 16))), F.lit(0))
    marks = every.select("word", bits.alias("mark")).where("mark > 0")
    at = F.xxhash64("text")
    asked = source.where(F.col("text").isNotNull()).select(at.alias("at"), "text", "fixes").mapInArrow(_asked(known), "at long, word string").distinct()
    held = asked.join(marks, "word").groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("word", "mark"))).alias("marks"))
    return source.withColumn("at", at).join(held, "at", "left").select("id", "text", "fixes", F.coalesce("marks", F.create_map().cast(_MARKS)).alias("marks"))


# -- places in the text as stored --------------------------------------------------------------


def mapped(text: str, known, fixes: dict | None) -> tuple[str, list[tuple[int, int]] | None]:
    """The form of ``text`` and, where it differs, the stored span that each character came from."""
    made = forms.form(text, known, fixes)
    if made == text:
        return text, None
    out: list[str] = []
    places: list[tuple[int, int]] = []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and unicodedata.combining(text[j]):
            j += 1
        piece = forms.fold(text[i:j])
        out.append(piece)
        places += [(i, j)] * len(piece)
        i = j
    joined = "".join(out)
    # Line ends and composition across pieces may change the length; what was read piece by piece then stands.
    return (made if len(joined) == len(made) else joined), places


def located(text: str, parts: Parts, known, fixes: dict | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity as read) of the findings, in places of the stored text."""
    read, places = mapped(text, known, fixes)
    return [(a, b, kind, read[a:b]) if places is None else (places[a][0], places[b - 1][1], kind, read[a:b]) for a, b, kind in findings(read, parts)]


# -- surrogates ----------------------------------------------------------------------------------

# Vowels of the scripts that have case; forms of address by gender; pronouns by gender;
# domains of public mail services, which tell of nobody.
VOWELS = frozenset("aeiouyαεηιουωаеиоуыэюяєіїё")
FEMALE_TITLES = frozenset("mrs ms miss frau mme mlle madame smt señora".split())
MALE_TITLES = frozenset("mr sir herr monsieur shri sri don señor".split())
FEMALE_WORDS = frozenset("she her hers herself elle ihre она её".split())
MALE_WORDS = frozenset("he him his himself il er sein он его".split())
PUBLIC_MAIL = frozenset("gmail.com googlemail.com yahoo.com hotmail.com outlook.com live.com icloud.com aol.com gmx.de gmx.net web.de mail.ru yandex.ru proton.me protonmail.com".split())
#: First and last code points of the letters and digits that surrogates are made of.
_ALPHABETS = ((0x30, 0x7A), (0xC0, 0x17F), (0x386, 0x3CE), (0x401, 0x45F), (0x5D0, 0x5EA), (0x621, 0x64A), (0x660, 0x669), *((a, a + 0x7F) for a in range(0x900, 0xD80, 0x80)), (0x3041, 0x30FE), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _class_name(char: str) -> tuple | None:
    """What a character may be exchanged within: script, category, vowel or not, accent or not; None for signs.

    In Indic scripts vowel signs are a class, and signs that change how a letter is read stay.
    """
    kind = unicodedata.category(char)
    if kind[0] not in "LNM":
        return None
    name = unicodedata.name(char, "")
    script = name.split(" ")[0]
    if kind == "Nd":
        return "digit", ord(char) - unicodedata.digit(char)
    if kind[0] == "M":
        return (script, "sign") if "VOWEL SIGN" in name else None
    base = unicodedata.normalize("NFD", char)[0].lower()
    if 0x900 <= ord(char) < 0xD80:
        if "LETTER" not in name or len(name.split("LETTER ")[-1].split(" ")) > 1:
            return None
        return script, "vowel" if name.split(" ")[-1][0] in "AEIOU" else "consonant"
    if len(unicodedata.normalize("NFD", char)) > 1:
        return script, kind, base in VOWELS, "accent"
    return script, kind, base in VOWELS, "plain" if char.isascii() else ""


@functools.cache
def _alphabets() -> tuple[dict[str, str], dict[str, int]]:
    """For each character its class, as a string, and its place in it; classes of one are left out."""
    found: dict[tuple, list[str]] = {}
    for low, high in _ALPHABETS:
        for point in range(low, high + 1):
            name = _class_name(chr(point))
            if name is not None:
                found.setdefault(name, []).append(chr(point))
    of, at = {}, {}
    for chars in found.values():
        if len(chars) > 1:
            joined = "".join(chars)
            for i, c in enumerate(chars):
                of[c], at[c] = joined, i
    return of, at


class Surrogates:
    """Keyed one-to-one replacements of entities, in the script and format of the entity.

    Listed names trade places with others of their script, of the roles they are listed in
    and of their gender; what gender a name is of comes from ``genders``, counts of the
    corpus. All else is enciphered. No replacement equals what it replaces.
    """

    def __init__(self, key: str, parts: Parts, genders: dict[str, str] | None = None):
        if not key:
            raise ValueError("surrogates need a key")
        self.key = key.encode()
        known = genders or {}
        groups: dict[tuple, list[str]] = {}
        for w in parts.listed_given | parts.listed_family:
            given = w in parts.listed_given
            groups.setdefault((_script(w[:1] or " "), given, w in parts.listed_family, known.get(w, "") if given else ""), []).append(w)
        for name in sorted(groups, key=lambda g: (len(groups[g]), str(g))):
            if len(groups[name]) == 1:  # the only one of its gender trades with those of none, else of the other; alone in its role it is enciphered
                near = [g for g in groups if g != name and g[:3] == name[:3]]
                if near:
                    groups[min(near, key=lambda g: g[3])] += groups.pop(name)
        self.pool: dict[str, str] = {}
        for words in groups.values():
            if len(words) > 1:
                order = sorted(words, key=lambda w: self._mac(f"part:{w}"))
                self.pool.update(zip(order, order[1:] + order[:1], strict=True))

    def _mac(self, text: str) -> bytes:
        return hmac.new(self.key, text.encode("utf-8", "surrogatepass"), hashlib.sha256).digest()

    def _number(self, text: str) -> int:
        return int.from_bytes(self._mac(text), "big")

    def cipher(self, text: str) -> str:
        """``text`` with each letter and digit exchanged within its class: one-to-one, and never the text itself.

        All places but the first go through four Feistel rounds that the first one takes part
        in; then the first is moved by one at least, by how much the others decide.
        """
        text = unicodedata.normalize("NFC", text)
        of, at = _alphabets()
        places = [i for i, c in enumerate(text) if c in of]
        if not places:
            return text
        symbols = [at[text[i]] for i in places]
        sizes = [len(of[text[i]]) for i in places]
        shape = "".join(of[c][0] if c in of else c for c in text)
        rest = range(1, len(places))
        half = 1 + (len(rest) + 1) // 2
        for turn in range(4):
            a, b = (range(1, half), range(half, len(places))) if turn % 2 == 0 else (range(half, len(places)), range(1, half))
            seed = f"{turn}:{shape}:{symbols[0]}:{','.join(str(symbols[k]) for k in b)}"
            for n, k in enumerate(a):
                if n % 8 == 0:
                    mac = self._mac(f"{n}:{seed}")
                symbols[k] = (symbols[k] + int.from_bytes(mac[4 * (n % 8) : 4 * (n % 8) + 4], "big")) % sizes[k]
        move = self._number(f"first:{shape}:{','.join(str(symbols[k]) for k in rest)}")
        symbols[0] = (symbols[0] + 1 + move % (sizes[0] - 1)) % sizes[0]
        out = list(text)
        for i, s in zip(places, symbols, strict=True):
            out[i] = of[text[i]][s]
        return "".join(out)

    def _outside(self, text: str, taken) -> str:
        """The cipher of a text outside ``taken``, walked on until outside it: still one-to-one, and it ends."""
        made = self.cipher(text)
        while made in taken and made != text:
            made = self.cipher(made)
        return made

    def _part(self, word: str) -> str:
        low = unicodedata.normalize("NFC", word.lower())
        made = self.pool.get(low) or self._outside(low, self.pool)
        return made.upper() if word.isupper() and len(word) > 1 else made[:1].upper() + made[1:] if word[:1].isupper() else made

    def _domain(self, domain: str) -> str:
        """A public service's domain as it is, any other enciphered but for its last label."""
        low = domain.lower()
        flat = re.sub(r"\s+dot\s+|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?", ".", low)
        if flat in PUBLIC_MAIL:
            return low
        head, dot, tail = re.match(rf"(.*)({_DOT}|\s+dot\s+)(.*)", low, re.DOTALL).groups() if re.search(rf"{_DOT}|\s+dot\s+", low) else (low, "", "")
        apart = re.split(rf"({_DOT}|\s+dot\s+)", head)
        made = "".join(self.cipher(p) if i % 2 == 0 else p for i, p in enumerate(apart)) + dot + tail
        return made if made not in PUBLIC_MAIL else self._domain(made)

    def of(self, entity: str, kind: str) -> str:
        """The surrogate of an entity in its ``canonical`` spelling."""
        if kind == "name":
            words = list(_WORD.finditer(entity))
            out, end = [], 0
            for i, m in enumerate(words):
                title = m[0].casefold() in _TITLES_LOW and i + 1 < len(words)
                out += [entity[end : m.start()], m[0] if title else self._part(m[0])]
                end = m.end()
            return "".join(out) + entity[end:]
        if kind == "email":
            m = re.match(r"(.*?)(\s?@\s?|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s+at\s+)(.*)", entity, _I | re.DOTALL)
            if m:
                return self.cipher(m[1].lower()) + m[2] + self._domain(m[3])
        if kind == "phone" and (m := re.match(r"(\+\d{1,3}|00\d{1,3}|0)(?=\D|\d{6})", entity)):
            return m[1] + self.cipher(entity[m.end() :])
        if kind == "address":
            return re.sub(rf"\b(?!(?:{'|'.join(STREETS)}|Flat|Unit|Apt|Apartment|Suite|House|No|Cross|Main|rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours|des|de|du|la|th|st|nd|rd)\b)\w+", lambda w: self.cipher(w[0]), entity, flags=_I)
        return self.cipher(entity)


_TITLES_LOW = frozenset(t.casefold() for t in TITLES)
_NAME_WORDS = re.compile(r"[^\W\d_]+")


def _gendered(known, sent):
    """Per listed given name, how often a name with it stands by a title or before a pronoun of either gender."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings, parts = known.value, sent.value
        seen: Counter = Counter()
        for batch in batches:
            for t, f, m in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if not t:
                    continue
                read = forms.form(t, readings, forms.plain(f))
                for start, end, kind in findings(read, _own(parts, m)):
                    if kind != "name":
                        continue
                    words = [w.casefold() for w in _WORD.findall(read[start:end])]
                    near = [w.casefold() for w in _NAME_WORDS.findall(read[end : end + 80])]
                    n = sum(w in FEMALE_TITLES for w in words) + sum(w in FEMALE_WORDS for w in near) - sum(w in MALE_TITLES for w in words) - sum(w in MALE_WORDS for w in near)
                    for w in words:
                        if w in parts.listed_given:
                            seen[w] += n
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["word", "n"])

    return run


def genders(source: DataFrame, known, parts) -> dict[str, str]:
    """``f`` or ``m`` of each listed given name for which the corpus tells; at most as many as are listed."""
    rows = source.mapInArrow(_gendered(known, parts), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n != 0").collect()
    return {r["word"]: "f" if r["n"] > 0 else "m" for r in rows}


def canonical(entity: str, kind: str) -> str:
    """One spelling of an entity, by which its mentions are recognised."""
    text = re.sub(r"\s+", " ", entity).strip()
    if kind == "name":
        return " ".join(w[:1].upper() + w[1:] for w in unicodedata.normalize("NFC", text.lower()).split(" "))
    if kind == "email":
        return text.lower()
    return unicodedata.normalize("NFC", text)


# -- operators -----------------------------------------------------------------------------------


def _prepared(df: DataFrame, names: DataFrame, id: str, text: str, max_parts: int = MAX_PARTS, **kw):
    source, known = forms.prepared(df, id, text, **kw)
    source, parts = learned(source.withColumn("id", F.col("id").cast("string")), known, names, max_parts)
    return source, known, df.sparkSession.sparkContext.broadcast(parts)


def _own(parts: Parts, marks) -> Parts:
    """The parts to read a text with, ``marks`` being a map as Arrow hands it over."""
    return parts if marks is None else Parts.held(dict(marks))


def kinds_found(df: DataFrame, names: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``id`` and ``kind`` of every kind of personal data that a record holds, each once."""
    source, known, parts = _prepared(df, names, id, text, **kw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings, names_ = known.value, parts.value
        for batch in batches:
            ids, kinds = [], []
            for i, t, f, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i is None or forms.blank(t):
                    continue
                for kind in {k for _, _, k in findings(forms.form(t, readings, forms.plain(f)), _own(names_, m))}:
                    ids.append(i)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string())], names=["id", "kind"])

    return source.mapInArrow(run, "id string, kind string").distinct().select(F.col("id").alias(id), "kind")


def masked(df: DataFrame, names: DataFrame, key: str, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``id``, ``masked`` (typed placeholders such as ``[EMAIL]``), ``surrogate`` (keyed replacements) and ``counts`` by kind."""
    source, known, parts = _prepared(df, names, id, text, **kw)
    told = genders(source, known, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings, names_ = known.value, parts.value
        made = Surrogates(key, names_, told)
        for batch in batches:
            plain, other, counts = [], [], []
            for t, f, m in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if t is None:
                    plain.append(None)
                    other.append(None)
                    counts.append([])
                    continue
                end, a, b, n = 0, [], [], Counter()
                for start, stop, kind, entity in located(t, _own(names_, m), readings, forms.plain(f)):
                    a += [t[end:start], f"[{kind.upper()}]"]
                    b += [t[end:start], made.of(canonical(entity, kind), kind)]
                    end = stop
                    n[kind] += 1
                plain.append("".join(a) + t[end:])
                other.append("".join(b) + t[end:])
                counts.append(sorted(n.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(plain, pa.string()), pa.array(other, pa.string()), pa.array(counts, pa.map_(pa.string(), pa.int32()))],
                names=["id", "masked", "surrogate", "counts"],
            )

    return source.mapInArrow(run, "id string, masked string, surrogate string, counts map<string,int>").select(F.col("id").alias(id), "masked", "surrogate", "counts")


def entities(df: DataFrame, names: DataFrame, key: str, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``kind``, ``entity``, ``surrogate`` and ``n`` of every distinct entity of the table."""
    source, known, parts = _prepared(df, names, id, text, **kw)
    told = genders(source, known, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings, names_ = known.value, parts.value
        made = Surrogates(key, names_, told)
        for batch in batches:
            rows: Counter = Counter()
            for t, f, m in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if t:
                    rows.update((k, canonical(e, k)) for _, _, k, e in located(t, _own(names_, m), readings, forms.plain(f)))
            keys = list(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.string()), pa.array([e for _, e in keys], pa.string()), pa.array([made.of(e, k) for k, e in keys], pa.string()), pa.array([rows[x] for x in keys], pa.int64())],
                names=["kind", "entity", "surrogate", "n"],
            )

    return source.mapInArrow(run, "kind string, entity string, surrogate string, n long").groupBy("kind", "entity", "surrogate").agg(F.sum("n").alias("n"))


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one entity, or for themselves: none, unless something is wrong."""
    per = found.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n_entities"), F.max(F.col("entity") == F.col("surrogate")).alias("unchanged"))
    return per.where("n_entities > 1 or unchanged")
