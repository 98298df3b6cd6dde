"""Column expressions over texts; no Python runs on the workers unless a name says so."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's ``str.split`` takes it, for a character class.
WS = r"\t\n\x{b}\x{c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Characters removed as noise, and control characters removed.
NOISE = "​﻿‎‏‪‫‬‭‮�"
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]"
# Words that mark English text, and words of the web-text heuristics.
ENGLISH = "the of and to in a is that for on with as was it by be at this from or an are his not but have he which you has were they their said will would who".split()
COMMON = "the be to of and that have with".split()
#: Symbols counted by the web-text heuristics.
SYMBOLS = r"[#@^*~<>{}\[\]|\\_=+`$%&]"


def text_of(column: str | Column) -> Column:
    """The text, a null taken as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is mentioned."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern without groups, in order."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+$", "")


def words(text: Column) -> Column:
    return matches(text, rf"[^{WS}]+")


def strip_noise(text: Column) -> Column:
    return F.translate(text, NOISE, "")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def collapse(text: Column) -> Column:
    """Runs of blanks and of line ends shortened, each line and the whole stripped."""
    runs = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(runs, "\n"), strip), "\n"))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities resolved (Arrow batches)."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition (Arrow batches)."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalized(text: Column, composed: bool = False) -> tuple[Column, Column]:
    """The normal form and the names of the steps that changed something, in order.

    The two steps that need Python come first and only on request.
    """
    steps = [("html_unescape", unescape), ("nfc", nfc)] if composed else []
    steps += [("strip_noise", strip_noise), ("strip_control", strip_control), ("collapse_ws", collapse)]
    names, now = [], text
    for name, step in steps:
        made = step(now)
        names.append(F.when(made != now, F.lit(name)))
        now = made
    return now, F.array_compact(F.array(*names))


def count_of(text: Column, pattern: str) -> Column:
    """Characters left when all but those of the class ``pattern`` negates are gone."""
    return F.length(F.regexp_replace(text, pattern, ""))


def letters(text: Column) -> Column:
    return count_of(text, r"[^\p{L}]+")


def latin_letters(text: Column) -> Column:
    return count_of(text, "[^A-Za-z]+")


def kannada_letters(text: Column) -> Column:
    return F.size(matches(text, r"[\x{c80}-\x{cff}]")) - F.size(matches(text, r"[\x{c81}-\x{c83}\x{cbc}\x{cbe}-\x{ccd}\x{cd5}-\x{cd6}\x{ce2}-\x{cef}\x{cf3}]"))


def ratio(part: Column, whole: Column) -> Column:
    """The quotient, 0 where the divisor is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ascii_words(text: Column) -> Column:
    return matches(F.lower(text), "[a-z']+")


def n_ascii_words(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("[a-z']+"))


def english_hits(text: Column) -> Column:
    """How many of the words are English stop words, in one pass of one pattern."""
    return F.regexp_count(F.lower(text), F.lit(f"(?<![a-z'])(?:{'|'.join(ENGLISH)})(?![a-z'])"))


def is_english(text: Column, latin: float = 0.7, stop: float = 0.04) -> Column:
    return (ratio(latin_letters(text), letters(text)) >= latin) & (ratio(english_hits(text), n_ascii_words(text)) >= stop)


def symbols(text: Column, indic_aware: bool = True) -> Column:
    keep = r"\x{900}-\x{d7f}" if indic_aware else ""
    return count_of(text, rf"[\p{{L}}\p{{N}}{WS}{keep}]+")


def lines(text: Column) -> Column:
    """Lines that hold more than white space, as they stand."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{WS}]"))


#: A line with text around two bars.
NAV = r"^.+\|.+\|.+"


def nav_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda line: line.rlike(NAV)))


def word_chars(text: Column) -> Column:
    return count_of(text, f"[{WS}]+")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS}]+"))


def quality_reasons(text: Column, min_chars: int = 200, symbol: float = 0.25, nav: float = 0.5, dup: float = 0.3, low: float = 1.2, high: float = 40.0) -> Column:
    """All reasons to drop a text, in a fixed order; none for one to keep."""
    def reasons(held: Column) -> Column:
        n, w, c = F.size(held), n_words(text), word_chars(text)
        navs = F.size(F.filter(held, lambda line: line.rlike(NAV)))
        return F.array_compact(F.array(
            F.when(F.length(text) < min_chars, F.lit("too_short")),
            F.when(symbols(text) / F.greatest(F.length(text), F.lit(1)) > symbol, F.lit("too_many_symbols")),
            F.when((n > 0) & (navs / n > nav), F.lit("boilerplate")),
            F.when((n > 0) & ((n - F.size(F.array_distinct(held))) / n > dup), F.lit("dup_lines")),
            F.when((w > 0) & ((c / w < low) | (c / w > high)), F.lit("word_len")),
        ))

    return let(lines(text), reasons)


def canonical(text: Column) -> Column:
    return F.lower(F.regexp_replace(strip(text), rf"[{WS}]+", " "))


def grams(found: Column, k: int) -> Column:
    """Distinct runs of k words; a shorter text is one run, an empty one none."""
    def runs(w: Column) -> Column:
        n = F.size(w)
        made = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(made))

    return let(found, runs)


def tokens(text: Column) -> Column:
    """Words and single signs of the lower-cased text."""
    return matches(F.lower(text), rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]")


def units(text: Column) -> Column:
    """Words with the white space before them; white space at the end stands alone. Lossless."""
    return matches(text, rf"[{WS}]*[^{WS}]+|[{WS}]+$")


def simple_tokens(text: Column) -> Column:
    return F.size(matches(text, rf"[\p{{L}}\p{{N}}]+|[^{WS}\p{{L}}\p{{N}}]"))


def effort_tokens(text: Column) -> Column:
    return F.size(matches(text, rf"[A-Za-z]+|[0-9]+|[^{WS}A-Za-z0-9]"))


def script(token: Column) -> Column:
    """The script of a token's first letter."""
    first = F.regexp_extract(token, r"(\p{L})", 1)
    named = {"Latin": r"\p{IsLatin}", "Devanagari": r"\p{IsDevanagari}", "Kannada": r"\p{IsKannada}", "Telugu": r"\p{IsTelugu}", "Cyrillic": r"\p{IsCyrillic}", "Greek": r"\p{IsGreek}"}
    out = F.when(first == "", "none")
    for name, pattern in named.items():
        out = out.when(first.rlike(pattern), name)
    return out.otherwise("other")


def subwords(word: Column) -> Column:
    """Latin words above 4 letters in fours, Devanagari above 3 in halves, others whole."""
    n = F.length(word)
    four = matches(word, r"[\s\S]{1,4}")
    half = F.ceil(n / 2).cast("int")
    halves = F.array(F.substring(word, F.lit(1), half), F.substring(word, half + 1, n))
    return F.when(word.rlike("^[A-Za-z]+$") & (n > 4), four).when(word.rlike(r"^[\x{900}-\x{97f}]+$") & (n > 3), halves).otherwise(F.array(word))


def heuristics(text: Column) -> dict[str, Column]:
    """The counts behind the nine rules of the web-text heuristics, whole numbers only."""
    ws, held = words(text), lines(text)
    clean = F.transform(ws, lambda w: F.regexp_replace(F.lower(w), r"[^a-z]", ""))
    return {
        "n_words": n_words(text),
        "n_chars": word_chars(text),
        "n_symbols": F.size(matches(text, SYMBOLS)),
        "n_lines": F.size(held),
        "n_ended": F.size(F.filter(held, lambda s: strip(s).rlike(r"[.!?\"']$"))),
        "n_distinct": F.size(F.array_distinct(F.transform(held, strip))),
        "n_common": F.size(F.array_distinct(F.filter(clean, lambda w: w.isin(COMMON)))),
        "n_bullets": F.size(F.filter(held, lambda s: strip(s).rlike(r"^[-*\x{2022}]"))),
        "n_dotted": F.size(F.filter(held, lambda s: strip(s).rlike(r"(?:\.\.\.|\x{2026})$"))),
    }


def passes(c: dict[str, Column] | None = None) -> Column:
    """Whether the counts of ``heuristics``, as columns of their names, pass every rule but the bigram one."""
    col = c or {n: F.col(n) for n in ("n_words", "n_chars", "n_symbols", "n_lines", "n_ended", "n_distinct", "n_common", "n_bullets", "n_dotted")}
    w, n = col["n_words"], col["n_lines"]
    return (
        w.between(50, 100_000) & (col["n_chars"] >= 3 * w) & (col["n_chars"] <= 10 * w) & (col["n_symbols"] * 10 < w)
        & (col["n_ended"] * 10 >= 3 * n) & ((n - col["n_distinct"]) * 10 < 3 * n) & (col["n_common"] >= 2)
        & (col["n_bullets"] * 10 < 9 * n) & (col["n_dotted"] * 10 < 3 * n)
    )
