"""One stored form for texts that look alike.

Width, composition, joined letter forms, invisible characters, and the kind of blank
or hyphen are folded character by character. Look-alike letters of other scripts need
their surroundings: a token's script is the one its unmistakable letters belong to
(else the text's), look-alikes are exchanged towards that script, and the exchange is
kept only where its result is known to the corpus, as a word written cleanly somewhere
or as the common reading of two different spellings.

Null stays null; empty and blank texts come back as they are, folded. Repeated rows
come back as often as they went in. Columns other than the two named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.runtime import Stage

#: Words the workers may hold of those that repairs lead to; beyond it they are joined.
MAX_BROADCAST_WORDS = 400_000
#: Distinct words a worker gathers before it hands them on.
FLUSH_WORDS = 300_000

# Characters that show nothing, as inclusive ranges.
INVISIBLE = (
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C),
    (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
)
# Hyphens that print as the plain one.
HYPHENS = (0x2010, 0x2011, 0xFE63, 0xFF0D)
# Letters of other scripts that print as the Latin letter beside them.
CYRILLIC_LOOKS = (
    "аa еe оo рp сc уy хx ѕs іi јj ԁd һh ԛq ԝw "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԚQ ԜW"
)
GREEK_LOOKS = "οo νv ρp ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"

#: Decompositions that only tell width, position or joining apart.
_SAME_SHAPE = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")

_TOKEN = re.compile("(?:[^\\W_]|[\u0300-\u036f])+")
_OTHER = re.compile("[Ͱ-ϿЀ-ԯ]")
_CONTROL = re.compile("[\x00-\x08\r\x0e-\x1f\x7f]")


def _pairs(text: str) -> dict[str, str]:
    return {p[0]: p[1] for p in text.split()}


_TO_LATIN = {"cyrillic": _pairs(CYRILLIC_LOOKS), "greek": _pairs(GREEK_LOOKS)}
_FROM_LATIN = {k: {b: a for a, b in v.items()} for k, v in _TO_LATIN.items()}
_SCRIPTS = ("latin", "cyrillic", "greek")


@functools.cache
def _table() -> tuple[dict[int, str | None], re.Pattern]:
    """What each character folds to, and a pattern of all that do."""
    to: dict[int, str | None] = {}
    for point in [*range(0x80, 0x30000)]:
        char = chr(point)
        kind = unicodedata.category(char)
        if kind == "Zs":
            to[point] = " "
        elif point in (0x85, 0x2028, 0x2029):
            to[point] = "\n"
        else:
            shape = unicodedata.decomposition(char)
            if shape.startswith(_SAME_SHAPE) or shape.startswith("<compat>") and kind[0] == "L":
                name = unicodedata.name(char, "")
                if shape.startswith(_SAME_SHAPE) or "LIGATURE" in name or "DIGRAPH" in name or re.search("CAPITAL LETTER (DZ|LJ|NJ)|SMALL LETTER (DZ|LJ|NJ)", name):
                    to[point] = unicodedata.normalize("NFKC", char)
    for point in HYPHENS:
        to[point] = "-"
    for low, high in INVISIBLE:
        for point in range(low, high + 1):
            to[point] = None
    runs: list[list[int]] = []
    for point in sorted(to):
        if runs and runs[-1][1] == point - 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    dirty = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    return to, re.compile(f"[{dirty}]")


def fold(text: str) -> str:
    """``text`` without the differences that no reader sees, look-alike letters apart."""
    if _CONTROL.search(text):
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    elif text.isascii():
        return text
    to, dirty = _table()
    text = dirty.sub(lambda m: to[ord(m[0])] or "", text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


@functools.cache
def _letter(char: str) -> tuple[str, bool]:
    """The script of a letter and whether it is unmistakable; '' for all else."""
    if not char.isalpha():
        return "", False
    base = unicodedata.normalize("NFD", char)[0]
    point = ord(base)
    if point < 0x250:
        return "latin", not any(base in m for m in _FROM_LATIN.values())
    if 0x400 <= point < 0x530:
        return "cyrillic", base not in _TO_LATIN["cyrillic"]
    if 0x370 <= point < 0x400:
        return "greek", base not in _TO_LATIN["greek"]
    return "other", True


@functools.cache
def _turned(char: str, target: str) -> str:
    """``char`` as the look-alike of the target script, else itself."""
    script = _letter(char)[0]
    if script in ("", "other", target):
        return char
    parts = unicodedata.normalize("NFD", char)
    base = parts[0]
    latin = base if script == "latin" else _TO_LATIN[script].get(base)
    if latin is None:
        return char
    made = latin if target == "latin" else _FROM_LATIN[target].get(latin)
    return char if made is None else made + parts[1:]


def _dominant(chars: str) -> str:
    votes = dict.fromkeys(_SCRIPTS, 0)
    for char, n in Counter(chars).items():
        script, sure = _letter(char)
        if sure and script in votes:
            votes[script] += n
    best = max(_SCRIPTS, key=lambda s: votes[s])
    return best if votes[best] else ""


@functools.lru_cache(1 << 16)
def _reading(token: str, around: str) -> str:
    target = _dominant(token) or around
    return unicodedata.normalize("NFC", "".join(_turned(c, target) for c in token))


def proposals(text: str) -> dict[str, str]:
    """Repairs a folded text asks for: token as stored -> token in one script.

    Only letters that cannot be mistaken decide on a script, and those are never
    exchanged, so texts that look alike propose the same readings.
    """
    if not _OTHER.search(text):
        return {}
    around = _dominant(text) or "latin"
    found = {}
    for token in set(_TOKEN.findall(text)):
        if around == "latin" and token.isascii():
            continue
        made = _reading(token, around)
        if made != token:
            found[token] = made
    return found


def form(text: str, known: frozenset | set, fixes: dict | None = None) -> str:
    """The one form of ``text``, given the readings that the corpus knows."""
    text = fold(text)
    if fixes is None:
        if not known:
            return text
        asked = proposals(text)
        fixes = {k: v for k, v in asked.items() if v.casefold() in known}
    if not fixes:
        return text
    return _TOKEN.sub(lambda m: fixes.get(m[0], m[0]), text)


_WORDS = pa.schema([("word", pa.string()), ("spelling", pa.string())])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words written cleanly (no spelling beside them) and readings with their spelling."""
    clean: set[str] = set()
    pieces: set[str] = set()
    asked: set[tuple[str, str]] = set()

    def out() -> pa.RecordBatch:
        for piece in pieces:  # a piece between blanks is split once, however often it occurs
            clean.update(_TOKEN.findall(piece))
        rows = [(w, None) for w in {w.casefold() for w in clean}] + list(asked)
        for held in (clean, pieces, asked):
            held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], schema=_WORDS)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            text = fold(text)
            wanted = proposals(text)
            if wanted:
                clean.update(set(_TOKEN.findall(text)) - wanted.keys())
                asked.update((v.casefold(), k) for k, v in wanted.items())
            else:
                pieces.update(text.split())
            if len(clean) + len(pieces) + len(asked) > FLUSH_WORDS:
                yield out()
    yield out()


def known_readings(df: DataFrame, text: str = "text") -> DataFrame:
    """Column ``word``: readings of mixed tokens that the corpus bears out."""
    words = df.select(F.col(text).cast("string").alias("text")).mapInArrow(_gather, "word string, spelling string")
    return (
        words.groupBy("word")
        .agg(
            F.max(F.col("spelling").isNull()).alias("clean"),
            F.min("spelling").alias("low"),
            F.max("spelling").alias("high"),
        )
        .where(F.col("low").isNotNull() & (F.col("clean") | (F.col("low") != F.col("high"))))
        .select("word")
    )


_FIXES = "map<string,string>"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(h, k, v, v.casefold()) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for k, v in proposals(fold(t)).items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))],
            names=["at", "spelling", "reading", "word"],
        )


def prepared(df: DataFrame, id: str, text: str, max_words: int = MAX_BROADCAST_WORDS, words: DataFrame | None = None) -> tuple[DataFrame, Broadcast]:
    """Columns ``id``, ``text``, ``fixes``, and the known readings, for ``form``.

    The readings are those of ``df`` itself, or of ``words`` if other tables share them.

    Up to ``max_words`` readings go to the workers; ``fixes`` is null then. Of a larger
    corpus, each text that needs repair gets its own by joins, and the set is empty.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    words = known_readings(rows) if words is None else words
    taken = words.limit(max_words + 1).collect()
    if len(taken) <= max_words:
        known = spark.sparkContext.broadcast(frozenset(r[0] for r in taken))
        return rows.withColumn("fixes", F.lit(None).cast(_FIXES)), known
    del taken
    at = F.xxhash64("text")
    asked = rows.where(F.col("text").isNotNull()).select(at.alias("at"), "text").mapInArrow(_asked, "at long, spelling string, reading string, word string")
    fixes = (
        asked.dropDuplicates(["at", "spelling"]).join(words, "word", "left_semi")
        .groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("spelling", "reading"))).alias("fixes"))
    )
    joined = rows.withColumn("at", at).join(fixes, "at", "left")
    none = F.create_map().cast(_FIXES)
    return joined.select("id", "text", F.coalesce("fixes", none).alias("fixes")), spark.sparkContext.broadcast(frozenset())


def plain(fixes) -> dict | None:
    """A map as Arrow hands it over, as a dict."""
    return None if fixes is None else dict(fixes)


def unified(df: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``id`` and ``text`` of every row, the text in its one form."""
    rows, known = prepared(df, id, text, **kw)
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            made = [t if t is None else form(t, words, plain(f)) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string").select(F.col("id").alias(id), F.col("text").alias(text))


def blank(text: str | None) -> bool:
    return not text or text.isspace()


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def lookalike_pairs(df: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Pairs ``<id>_a < <id>_b`` of records that look the same but are stored differently.

    Null and blank texts pair with nothing; a record delivered twice counts once. Pairs
    are formed between the different spellings of one look, then spread over the records
    that hold them, so records with equal texts never meet.
    """
    rows, known = prepared(df, id, text, **kw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            ids, looks, stored = [], [], []
            for i, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i is not None and not blank(t):
                    made = form(t, words, plain(f))
                    if not blank(made):
                        ids.append(i)
                        looks.append(_key(made))
                        stored.append(_key(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(looks, pa.binary()), pa.array(stored, pa.binary())], names=["id", "look", "stored"])

    stage = Stage(df.sparkSession, "forms")
    marks = stage.keep(rows.withColumn("id", F.col("id").cast("string")).mapInArrow(run, "id string, look binary, stored binary"), "marks")
    several = marks.groupBy("look").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where("low != high").select("look")
    held = marks.join(several, "look", "left_semi").distinct()
    spelt = held.select("look", "stored").distinct()
    met = (
        spelt.join(spelt.select("look", F.col("stored").alias("other")), "look")
        .where(F.col("stored") < F.col("other"))
        .select("stored", "other")
    )
    left = held.select("stored", F.col("id").alias("x"))
    right = held.select(F.col("stored").alias("other"), F.col("id").alias("y"))
    pairs = met.join(left, "stored").join(right, "other").where(F.col("x") != F.col("y"))
    least, most = _ordered(F.col("x"), F.col("y"))
    return pairs.select(least.alias(f"{id}_a"), most.alias(f"{id}_b")).distinct()


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)
