"""Rows that hold template residue, filler, error pages or script notices, not content.

Character n-gram models are fitted, one each: filler and leftover markup, error and script
notices, navigation (all three on the public texts of ``residue_texts``), and natural text
on a few public lines and the whole table, without what already reads as residue. What the
table holds of residue joins the first two models, so that they learn this table's own wording
(``ROUNDS`` times). Each position of a text scores the log-likelihood ratio of its n-gram
for each model; windows whose mean favours filler or a notice are marked, windows that
favour navigation are left out of account, and a row is excluded when the marked share of
what remains reaches ``coverage``. Unfilled placeholders are too short for windows: they
are a stage of their own, found by their syntax, and count when they stand in running
text, neither quoted nor in a line of code.

The models are fitted on every row, whatever its length: a pass counts n-grams and each round
takes one more, all as sums of whole numbers, so that neither order nor partitions matter.
A caller may bound the fit to the ``sample`` rows and ``chars`` characters of the least id
hashes; every row is scored over its whole text all the same. Null and blank texts are never
excluded; ids that occur more than once are judged row by row. Columns not named are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodeworks.llm.residue_texts import FILLER, MARKUP, NATURAL, NAVIGATION, NOTICE

#: Share of a row from which it is excluded: half of it; and from which it is no longer taken for natural text.
COVERAGE, DOUBT = 0.5, 0.2
#: Coverage from which a row teaches the residue models, and how often they are fitted again.
SURE, ROUNDS = 0.7, 2
#: Characters of an n-gram, of a window, and entries of the score table.
GRAM, WINDOW, TABLE = 5, 24, 1 << 20
#: Added count, bound of a score, and score of an n-gram that no model knows.
LEAST, CLIP, UNKNOWN = 0.05, 3.0, -0.4
#: Steps of a score from 0 to 1: sums of whole numbers are the same whatever texts are laid together.
STEPS = 1024
#: Characters laid together, n-grams held before they are counted, and slices in which counts are summed.
CHARS, HELD, PARTS = 1 << 18, 1 << 21, 64

# The syntaxes of placeholders, each with a name of letters inside.
_NAME = r"[A-Za-z][\w.]*(?:[ \t\r\n]+[A-Za-z][\w.]*){0,3}"
PLACEHOLDERS = (
    rf"\{{\{{\s*{_NAME}\s*\}}\}}", rf"\[\[\s*{_NAME}\s*\]\]", rf"<%=?\s*{_NAME}\s*%>", rf"%%\s*{_NAME}\s*%%", rf"@@\s*{_NAME}\s*@@",
    r"__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__", r"\[[Yy]our\s+[\w\s]{2,30}\]", r"\[YOUR\s+[\w\s]{2,30}\]", r"\[(?:INSERT|Insert|insert|ENTER|Enter)\s+[\w\s]{2,40}\]", rf"[$#]\{{\s*{_NAME}\s*\}}",
    rf"\{{%\s*{_NAME}\s*%\}}", r"<<\s*[a-z][a-z_.]+\s*>>", r"%\([a-z_.]+\)[sd]", r"<[a-z][a-z_ \r\n]{2,30}\s(?:goes\s+)?here>", r"(?<![\w$#{%\\}])\{[a-z][a-z_.]{2,}\}(?!\})",
)
_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS))
#: One of these is in every placeholder.
_OPENERS = ("{", "[", "<", "%", "@@", "__")
_CODE = re.compile(
    r"^\s*(?:<\w+[^>]*>.*</\w+>|</?\w+[^<>]*/?>\s*$|(?:def|class|return|for|while|if|elif|else|import|from|export|echo|const|let|var|function|print|query|assert|raise|with|try|except|SELECT|INSERT INTO|#include|//|/\*|\$ |@\w+$)\b.*[(){};:=<>\"'$]|[\w.\[\]]+\s*[-+*/|]?=[^=].*|.*[;{]\s*$|.*\)\s*[;:]?\s*$(?<=[;:])|.*\{#.*#\})"
)
_QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’", "«": "»", "„": "“", "(": ")"}


def unfilled(text: str) -> bool:
    """Whether a placeholder stands in running text, neither quoted nor in code."""
    if not any(o in text for o in _OPENERS):
        return False
    for hit in _PLACEHOLDER.finditer(text):
        start, end = hit.span()
        first = text.rfind("\n", 0, start) + 1
        last = text.find("\n", end)
        line = text[first : last if last >= 0 else len(text)]
        if _CODE.match(line):
            continue
        if _quoted(text, start, end):
            continue
        rest = _PLACEHOLDER.sub(" ", line)
        if sum(map(str.isalpha, rest)) >= 3:
            return True
    return False


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether the nearest marks before and after, within a sentence or so, are a pair of quotes."""
    before, after = text[max(0, start - 80) : start], text[end : end + 80]
    for opened, closed in (("`", "`"), ('"', '"'), ("“", "”"), ("«", "»"), ("„", "“")):
        if opened == closed:
            inside = before.rsplit("\n\n", 1)[-1].count(opened) % 2 == 1 and opened in after.split("\n\n", 1)[0]
        else:
            inside = before.rfind(opened) > before.rfind(closed) and closed in after
        if inside:
            return True
    return before[-1:] in "'‘" and before[-1:] != "" and after[:1] in "'’" and after[:1] != ""


#: A copyright line, or short entries between bars: navigation whatever its words.
_AROUND = re.compile(r"\s*©.{0,80}$|\s*[^|\n]{1,30}(?:\s\|\s[^|\n]{1,30}){2,}$")
_BLANKS = re.compile(r"[^\S\n]+")


#: Characters as the models see them: lower case, digits alike, blanks alike.
_FOLD = np.array(
    [10 if c == "\n" else 32 if c.isspace() else 48 if "0" <= c <= "9" else ord(c.lower()[0]) for c in map(chr, range(0x20000))], np.uint32
)


class Laid:
    """Texts laid one after the other, runs of blanks as one, line feeds between them: an n-gram never sees two texts."""

    def __init__(self, texts: list[str]):
        gap = "\n" * (GRAM - 1)
        points = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = _FOLD.take(points, mode="clip")
        beyond = points >= len(_FOLD)
        if beyond.any():
            folded[beyond] = points[beyond]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + len(gap))
        starts = ends - sizes
        blank = folded == 32
        again = np.flatnonzero(blank[1:] & blank[:-1]) + 1
        if len(again):
            folded = np.delete(folded, again)
            starts, ends = (at - np.searchsorted(again, at) for at in (starts, ends))
        n = len(folded)
        made = np.zeros(n - GRAM + 1, np.uint32)
        for i in range(GRAM):
            made ^= folded[i : n - GRAM + 1 + i]
            made *= np.uint32(0x9E3779B1)
            made ^= made >> np.uint32(15)
        made &= np.uint32(TABLE - 1)
        #: Hashed n-gram that ends at each position; the first characters are a gap.
        self.codes = np.zeros(n, np.int64)
        self.codes[GRAM - 1 :] = made
        self.folded, self.starts, self.ends = folded, starts, ends

    def own(self) -> np.ndarray:
        """Codes of the texts, without the gaps."""
        inside = np.ones(len(self.codes), bool)
        inside[: GRAM - 1] = False
        inside[(self.ends[:, None] + np.arange(GRAM - 1)).ravel()] = False
        return self.codes[inside]


def _laid(texts: list[str]) -> Iterator[tuple[slice, Laid]]:
    """``texts`` in turn, as many together as hold ``CHARS`` characters."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHARS or i == len(texts) - 1:
            yield slice(first, i + 1), Laid(texts[first : i + 1])
            first, held = i + 1, 0


class Counts:
    """Occurrences of each n-gram."""

    def __init__(self):
        self.total, self.waiting, self.held = np.zeros(TABLE, np.int64), [], 0

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes.astype(np.int32))
        self.held += len(codes)
        if self.held >= HELD:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.waiting:
            self.total += np.bincount(np.concatenate(self.waiting), minlength=TABLE)
            self.waiting, self.held = [], 0
        return self.total

    @classmethod
    def of(cls, texts: list[str]) -> np.ndarray:
        made = cls()
        for _, laid in _laid(texts):
            made.add(laid.own())
        return made.settle()


class Model:
    """Score tables of filler, of notices and of navigation against natural text."""

    def __init__(self, taught: list[np.ndarray], navigation: np.ndarray, prose: np.ndarray):
        self.residue = np.stack([self.ratio(k, prose) for k in taught])
        self.navigation = self.ratio(navigation, prose + taught[0] + taught[1])

    @staticmethod
    def ratio(of: np.ndarray, against: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each n-gram in ``STEPS``; one that neither knows counts a little against.

        Natural text counts as twice as much as the other at least, lest a table of a few rows outweigh it.
        """
        p = (of + LEAST) / (of.sum() + LEAST * (of > 0).sum() + LEAST)
        q = (against + LEAST) / (max(against.sum(), 2 * of.sum()) + LEAST * (against > 0).sum() + LEAST)
        known = np.clip(np.log(p / q), -CLIP, CLIP)
        known[of == 0] = -CLIP
        known[(of == 0) & (against == 0)] = UNKNOWN
        return np.rint(known * STEPS).astype(np.int16)

    def coverages(self, texts: list[str]) -> np.ndarray:
        """Per text, shares of it, white space and navigation apart, in windows of filler, of notices, of either."""
        shares = np.zeros((len(texts), 3))
        for where, laid in _laid(texts):
            good = [self._windows(scores.take(laid.codes), laid) for scores in self.residue]
            at = np.flatnonzero(good[0] | good[1])
            for i in np.unique(np.searchsorted(laid.starts, at, "right") - 1).tolist():
                shares[where.start + i] = self._shares(texts[where.start + i], laid, i, good)
        return shares

    @staticmethod
    def _windows(score: np.ndarray, laid: Laid) -> np.ndarray:
        """Where a window begins, inside one text, whose mean score is above zero; a shorter text is one window."""
        sums = np.zeros(len(score) + 1, np.int32)
        np.cumsum(score, dtype=np.int32, out=sums[1:])  # may wrap around, the differences are right
        good = np.zeros(len(score), bool)
        good[: max(len(score) - WINDOW + 1, 0)] = sums[WINDOW:] - sums[:-WINDOW] > 0
        past = (laid.ends[:, None] + np.arange(1 - WINDOW, GRAM - 1)).ravel()
        good[past[past >= 0]] = False
        good[: GRAM - 1] = False
        short = laid.ends - laid.starts < WINDOW
        for start, end in zip(laid.starts[short].tolist(), laid.ends[short].tolist(), strict=True):
            good[start:end] = False
            good[start : start + (end > start)] = sums[end] - sums[start] > 0
        return good

    def _shares(self, text: str, laid: Laid, i: int, good: list[np.ndarray]) -> tuple[float, float, float]:
        start, end = int(laid.starts[i]), int(laid.ends[i])
        n, folded = end - start, laid.folded[start:end]
        seen = (folded != 32) & (folded != 10)
        if not seen.any():
            return 0.0, 0.0, 0.0
        marked = []
        for g in good:
            edge = np.zeros(n + 1, np.int32)
            begun = g[start:end]
            edge[:-1] += begun
            width = min(WINDOW, n)
            edge[width:] -= g[start : end - width + 1]
            marked.append(np.cumsum(edge[:-1]) > 0)
        towards = np.zeros(n + 1, np.int64)
        np.cumsum(self.navigation.take(laid.codes[start:end]), out=towards[1:])
        at = 0
        for line in _BLANKS.sub(" ", text).split("\n"):
            to = at + len(line)
            if ("©" in line or "|" in line) and _AROUND.match(line) or towards[to] > towards[at] and 2 < len(line.strip()) < 80:
                seen[at:to] = False
            at = to + 1
        total = int(seen.sum())
        if not total:
            return 0.0, 0.0, 0.0
        filler, notice = (float((m & seen).sum() / total) for m in marked)
        return filler, notice, float(((marked[0] | marked[1]) & seen).sum() / total)


def _summed(rows: DataFrame, kinds: int, choose) -> list[np.ndarray]:
    """Counts of ``kinds`` over all rows; ``choose`` gives for a list of texts those of each kind."""
    size = TABLE // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counts() for _ in range(kinds)]
        for batch in batches:
            for into, chosen in zip(counts, choose(batch.column(0).to_pylist()), strict=True):
                for _, laid in _laid(chosen):
                    into.add(laid.own())
        yield from _packed({(k, p): c.settle()[p * size : (p + 1) * size] for k, c in enumerate(counts) for p in range(PARTS)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                into = sums.setdefault((r["kind"], r["part"]), np.zeros(size, np.int64))
                into[np.frombuffer(r["codes"], np.int32)] += np.frombuffer(r["counts"], np.int64)
        yield from _packed(sums)

    made = [np.zeros(TABLE, np.int64) for _ in range(kinds)]
    for r in rows.mapInArrow(count, _PACKED).repartition("kind", "part").mapInArrow(add, _PACKED).collect():
        made[r["kind"]][r["part"] * size + np.frombuffer(r["codes"], np.int32)] += np.frombuffer(r["counts"], np.int64)
    return made


_PACKED = "kind int, part int, codes binary, counts binary"


def _packed(counts: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts above zero of each slice that has any, a row each."""
    for (kind, part), c in counts.items():
        codes = np.flatnonzero(c)
        if len(codes):
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([codes.astype(np.int32).tobytes()], pa.binary()), pa.array([c[codes].tobytes()], pa.binary())],
                names=["kind", "part", "codes", "counts"],
            )


def fitted(df: DataFrame, id: str = "doc_id", text: str = "text", sample: int | None = None, chars: int | None = None) -> Model:
    """Models for ``df``, their counts from all of its rows, or from those of the least id hashes where ``sample`` or ``chars`` is given."""
    rows = df.select(F.col(text).cast("string").alias("t"), F.xxhash64(F.col(id).cast("string")).alias("h")).where("t IS NOT NULL")
    if sample is not None:
        rows = rows.orderBy("h", "t").limit(sample)
    if chars is not None:
        rows = rows.withColumn("held", F.sum(F.length("t")).over(Window.orderBy("h", "t").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("held") <= chars)
    rows = rows.select("t")
    lines = lambda *lists: Counts.of(["\n" + line for s in lists for line in s.split("\n")])
    seeds, navigation = [lines(FILLER, MARKUP), lines(NOTICE)], lines(NAVIGATION)
    everything, open_ = _summed(rows, 2, lambda texts: (texts, [t for t in texts if unfilled(t)]))
    everything += lines(NATURAL)
    model = Model(seeds, navigation, everything)
    for _ in range(ROUNDS):
        sent = df.sparkSession.sparkContext.broadcast(model)
        doubtful, *learned = _summed(rows, 3, _lessons(sent))
        sent.destroy()
        model = Model([seed + k for seed, k in zip(seeds, learned, strict=True)], navigation, everything - open_ - doubtful)
    return model


def _lessons(sent: Broadcast[Model]):
    """The texts no longer taken for natural (those with placeholders, counted before, apart), and those that teach filler and notices."""

    def choose(texts: list[str]) -> tuple[list[str], list[str], list[str]]:
        shares = sent.value.coverages(texts)
        read = [(t, s) for t, s in zip(texts, shares.tolist(), strict=True) if s[-1] >= DOUBT]
        sure = [(t, s) for t, s in read if s[-1] >= SURE]
        return [t for t, _ in read if not unfilled(t)], *([t for t, s in sure if s[k] == max(s[:-1])] for k in range(2))

    return choose


def judged(df: DataFrame, id: str = "doc_id", text: str = "text", coverage: float = COVERAGE, **kw) -> DataFrame:
    """``id``, ``filler``, ``notice``, ``coverage``, ``placeholder`` and ``residue`` of every row."""
    sent = df.sparkSession.sparkContext.broadcast(fitted(df, id, text, **kw))
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            shares = model.coverages(texts)
            columns = [pa.array(shares[:, k], pa.float64()) for k in range(3)]
            open_ = pa.array([unfilled(t) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, open_], names=["id", "filler", "notice", "coverage", "placeholder"])

    made = rows.mapInArrow(run, f"id {kind}, filler double, notice double, coverage double, placeholder boolean")
    return made.select(F.col("id").alias(id), "filler", "notice", "coverage", "placeholder", (F.col("placeholder") | (F.col("coverage") >= coverage)).alias("residue"))


def residue_ids(df: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Ids of the rows to exclude, each once."""
    return judged(df, id, text, **kw).where("residue").select(id).distinct()


def without_residue(df: DataFrame, id: str = "doc_id", text: str = "text", coverage: float = COVERAGE, **kw) -> DataFrame:
    """The table without the rows to exclude, judged one by one in a single pass, all columns kept."""
    sent = df.sparkSession.sparkContext.broadcast(fitted(df, id, text, **kw))

    @F.pandas_udf(BooleanType())
    def content(texts: pd.Series) -> pd.Series:
        texts = [t or "" for t in texts]
        shares = sent.value.coverages(texts)[:, -1].tolist()
        return pd.Series([not t or not (s >= coverage or unfilled(t)) for t, s in zip(texts, shares, strict=True)], dtype=bool)

    return df.where(content(F.col(text).cast("string")))
