"""Records that contain passages of held-out evaluation items.

Every window of ``span`` consecutive words gets a 64-bit SimHash, the sign of the
weighted sum of its words' random vectors, kept up by running sums. The items' windows
are few and are indexed on every worker by blocks of their bits: two fingerprints within
``radius`` bits agree in at least one of radius + 1 blocks, so no window within the
radius is missed. Candidates within the radius are compared by the weighted Jaccard
similarity of their shingles (words, and neighbours in order), and at the default
similarity of 1 the words themselves have the last say.

An index beyond ``max_windows`` windows is worked off in blocks of items, each against
all records. Words are unbroken runs of letters and digits, case ignored, in the form of
``forms``. Null and blank texts contain nothing; items shorter than ``span`` cannot leak;
repeated rows count once. Columns not named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm import forms
from lodeworks.llm.nearcopies import words
from lodeworks.runtime import Stage

SPAN = 13
RADIUS = 2
SIMILARITY = 1.0
#: Item windows that are indexed on every worker at a time, about 150 bytes each.
MAX_WINDOWS = 1_000_000
_BITS = 64
_CHUNK = 120_000


@functools.lru_cache(1 << 18)
def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Vectors:
    """Word numbers and their weighted sign vectors, grown as words appear."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, _BITS), np.int8)

    def of(self, found: list[str]) -> np.ndarray:
        number = self.number
        new = set(found).difference(number)
        if new:
            need = len(number) + len(new)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(need, len(self.rows) * 2) - len(self.rows), _BITS), np.int8)])
            hashes = np.array([_hash(w) for w in new], np.uint64)
            signs = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
            weight = np.array([1 + min(3, len(w) // 4) for w in new], np.int8)  # longer words tell more
            at = len(number)
            self.rows[at:need] = signs * weight[:, None]
            for w in new:
                number[w] = at
                at += 1
        return np.fromiter(map(number.__getitem__, found), np.int32, len(found))


def fingerprints(vectors: Vectors, numbers: np.ndarray, span: int) -> np.ndarray:
    """SimHash of each window of ``span`` words."""
    out = []
    for at in range(0, len(numbers) - span + 1, _CHUNK):
        part = vectors.rows[numbers[at : at + _CHUNK + span - 1]]
        sums = np.zeros((len(part) - span + 1, _BITS), np.int16)
        width = 1
        level, start = part.astype(np.int16), 0
        left = span
        while left:  # windows of 1, 2, 4, ... words add up to one of span words
            if left & 1:
                sums += level[start : start + len(sums)]
                start += width
            left >>= 1
            if left:
                level = level[:-width] + level[width:]
                width *= 2
        out.append(np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of radius + 1 blocks that make up the fingerprint."""
    n = radius + 1
    edges = [_BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


class Index:
    """The windows of a set of items, found by any block of their fingerprints."""

    def __init__(self, items: list[tuple], span: int, radius: int):
        self.span, self.radius = span, radius
        vectors = Vectors()
        self.windows: list[tuple[str, ...]] = []
        owner, prints = [], []
        for item, text in items:
            found = words(text)
            if len(found) >= span:
                prints.append(fingerprints(vectors, vectors.of(found), span))
                self.windows += [tuple(found[i : i + span]) for i in range(len(found) - span + 1)]
                owner += [item] * (len(found) - span + 1)
        self.owner = np.array(owner, object)
        self.prints = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        self.tables = []
        for shift, bits in _blocks(radius):
            keys = self.key(self.prints, shift, bits)
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[self._fold(keys)] = True
            self.tables.append((shift, bits, keys[order], order, sieve))

    @staticmethod
    def key(prints: np.ndarray, shift: int, bits: int) -> np.ndarray:
        return (prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)

    @staticmethod
    def _fold(keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(20)) ^ (keys >> np.uint64(40))) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in ``prints``, in the index) within the radius."""
        mine, theirs = [], []
        for shift, bits, keys, order, sieve in self.tables:
            asked = self.key(prints, shift, bits)
            at = np.flatnonzero(sieve[self._fold(asked)])
            low, high = np.searchsorted(keys, asked[at], "left"), np.searchsorted(keys, asked[at], "right")
            n = high - low
            if n.any():
                first = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                mine.append(np.repeat(at, n))
                theirs.append(order[first + np.arange(n.sum())])
        if not mine:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        m, t = np.concatenate(mine), np.concatenate(theirs)
        close = np.bitwise_count(prints[m] ^ self.prints[t]) <= self.radius
        return m[close], t[close]


def weighted_similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Weighted Jaccard of the shingles of two windows: each word, and each two in order."""
    x, y = (Counter([*w, *zip(w, w[1:], strict=False)]) for w in (a, b))
    weight = lambda s: len(s) if isinstance(s, str) else len(s[0]) + len(s[1])
    keys = x.keys() | y.keys()
    most = sum(weight(s) * max(x[s], y[s]) for s in keys)
    return sum(weight(s) * min(x[s], y[s]) for s in keys) / most if most else 0.0


def _found(known, sent, item_type: pa.DataType, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, readings, vectors = sent.value, known.value, Vectors()
        span = index.span
        for batch in batches:
            ids, items = [], []
            held: list[tuple[str, list[str]]] = []

            def scan() -> None:
                if not held:
                    return
                if len(vectors.number) > vectors.limit:
                    vectors.clear()
                flat = [w for _, ws in held for w in ws]
                starts = np.cumsum([0, *(len(ws) for _, ws in held)])
                mine, theirs = index.near(fingerprints(vectors, vectors.of(flat), span))
                doc = np.searchsorted(starts, mine, "right") - 1
                inside = mine + span <= starts[doc + 1]
                done = set()
                for m, t, d in zip(mine[inside], theirs[inside], doc[inside], strict=True):
                    item = index.owner[t]
                    if (d, item) in done:
                        continue
                    window = tuple(flat[m : m + span])
                    if weighted_similarity(window, index.windows[t]) >= similarity and (similarity < 1 or window == index.windows[t]):
                        done.add((d, item))
                        ids.append(held[d][0])
                        items.append(item)
                held.clear()

            size = 0
            for i, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i is None or forms.blank(t):
                    continue
                found = words(forms.form(t, readings, forms.plain(f)))
                if len(found) >= span:
                    held.append((i, found))
                    size += len(found)
                    if size > _CHUNK:
                        scan()
                        size = 0
            scan()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(items, item_type)], names=["id", "item"])

    return run


def leaked(df: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, radius: int = RADIUS, similarity: float = SIMILARITY, max_windows: int = MAX_WINDOWS, **kw) -> DataFrame:
    """Pairs (``id``, ``item``) of records and the items of which they hold a passage."""
    spark = df.sparkSession
    kind = items.schema[item].dataType.simpleString()
    arrow = pa.int64() if kind in ("bigint", "int") else pa.string()
    cast = "bigint" if arrow == pa.int64() else "string"
    every = df.select(F.col(text).cast("string").alias("text")).union(items.select(F.col(item_text).cast("string")))
    readings = Stage(spark, "leakage").keep(forms.known_readings(every), "readings")  # one set, so that a passage is read alike in both
    source, known = forms.prepared(df, id, text, words=readings, **kw)
    source = source.withColumn("id", F.col("id").cast("string"))
    spoken, item_known = forms.prepared(items.where(F.col(item).isNotNull()), item, item_text, words=readings, **kw)
    spoken = spoken.withColumn("id", F.col("id").cast(cast)).where(F.length(F.trim("text")) > 0).dropDuplicates(["id", "text"])
    parts = []
    held: list[tuple] = []
    size = 0

    def close() -> None:
        sent = spark.sparkContext.broadcast(Index(held, span, radius))
        parts.append(source.mapInArrow(_found(known, sent, arrow, similarity), f"id string, item {cast}"))

    for row in spoken.toLocalIterator():  # one partition at a time; a block is indexed when it is full
        made = forms.form(row["text"], item_known.value, forms.plain(row["fixes"]))
        held.append((row["id"], made))
        size += len(made) // 3
        if size > max_windows:
            close()
            held, size = [], 0
    if held or not parts:
        close()
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.distinct().select(F.col("id").alias(id), F.col("item").alias(item))
