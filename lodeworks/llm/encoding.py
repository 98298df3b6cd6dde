"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

The vocabulary (a file of base64 pieces and ranks) is serialised into a sentencepiece
BPE model: every byte is mapped to a visible character, each piece scores its negative
rank, and normalisation is the identity. Texts are cut into pre-tokens, each distinct
stretch between blanks is encoded once per worker, and ids decode by the inverse map.

A null and an empty text both give an empty list; blank texts are encoded as they are.
Repeated rows come back as often as they went in; columns not named are ignored.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Distinct stretches whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 200_000

# The white space of the pre-token pattern.
_WHITE = "\t\n\v\f\r \x85\xa0  -     　"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protocol-buffer field."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


@functools.cache
def byte_marks() -> list[str]:
    """A visible character for each byte: itself where it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    marks, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in marks:
            marks[b] = chr(extra)
            extra += 1
    return [marks[b] for b in range(256)]


def ranks(path: str | Path) -> list[bytes]:
    """The pieces of a rank file, in order of their ids."""
    pieces: dict[int, bytes] = {}
    for line in Path(path).read_bytes().splitlines():
        piece, rank = line.split()
        pieces[int(rank)] = base64.b64decode(piece)
    return [pieces[i] for i in range(len(pieces))]


def model_proto(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is id i; one more id stands for unknown."""
    marks = byte_marks()
    normal, unknown = 1, 2
    out = bytearray()
    for rank, piece in enumerate(pieces):
        text = "".join(marks[b] for b in piece)
        out += _field(1, _field(1, text) + _field(2, -float(rank)) + _field(3, normal))
    out += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown))
    bpe = 2
    out += _field(2, _field(3, bpe) + _field(4, len(pieces) + 1) + b"".join(_field(n, v) for n, v in ((40, len(pieces)), (41, -1), (42, -1), (43, -1))))
    out += _field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


@functools.cache
def pretoken_pattern() -> str:
    """Contractions, letters, numbers, other signs, each with one blank before it; white space."""
    letters: list[list[int]] = []
    numbers: list[list[int]] = []
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LN":
            runs = letters if kind == "L" else numbers
            if runs and runs[-1][1] == point - 1:
                runs[-1][1] = point
            else:
                runs.append([point, point])
    of = lambda runs: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    ls, ns = of(letters), of(numbers)
    return f"'(?:[sdmt]|ll|ve|re)| ?[{ls}]+| ?[{ns}]+| ?[^{_WHITE}{ls}{ns}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


class Encoder:
    """Text to ids and back; one per worker."""

    def __init__(self, proto: bytes, pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.cut = re.compile(pattern).findall
        self.split = re.compile(f" (?=[^{_WHITE}])").split
        self.loose = re.compile(f" (?:[{_WHITE}]|$)").search
        self.marks = dict(enumerate(byte_marks()))
        self.seen: dict[str, list[int]] = {}

    def _learn(self, stretches: list[str]) -> None:
        if len(self.seen) + len(stretches) > REMEMBERED:
            self.seen.clear()
        parts = [self.cut(s) for s in stretches]
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.marks) for ps in parts for p in ps]
        ids = iter(self.model.encode(mapped, num_threads=1))
        for stretch, ps in zip(stretches, parts, strict=True):
            self.seen[stretch] = [i for _ in ps for i in next(ids)]

    def stretches(self, text: str) -> list[str]:
        """``text`` cut before each blank that a visible character follows.

        No pre-token reaches over such a blank, and none looks past it, so the stretches
        can be cut into pre-tokens one by one.
        """
        parts = self.split(text) if self.loose(text) else text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        parts = self.stretches(text)
        seen = self.seen
        new = [p for p in dict.fromkeys(parts) if p not in seen]
        if new:
            self._learn(new)
            if any(p not in self.seen for p in parts):  # the memory was emptied in between
                self._learn(list(dict.fromkeys(parts)))
        out: list[int] = []
        for p in parts:
            out += seen[p]
        return out

    def decode(self, ids: list[int]) -> str:
        back = {m: b for b, m in self.marks.items()}
        return bytes(back[c] for i in ids for c in self.model.id_to_piece(i)).decode("utf-8", "replace")


@functools.lru_cache(4)
def encoder(folder: str = TOKENIZERS, file: str = BYTE_BPE) -> Encoder:
    return Encoder(model_proto(ranks(Path(folder) / file)), pretoken_pattern())


_worker: dict[str, Encoder] = {}


def shared_encoder(df: DataFrame, folder: str = TOKENIZERS, file: str = BYTE_BPE):
    """A function for the workers that gives their encoder, built from a broadcast model."""
    proto = model_proto(ranks(Path(folder) / file))
    sent = df.sparkSession.sparkContext.broadcast((proto, pretoken_pattern()))
    key = hashlib.sha256(proto).hexdigest()

    def get() -> Encoder:
        from lodeworks.llm import encoding

        held = encoding._worker
        if key not in held:
            held.clear()
            held[key] = Encoder(*sent.value)
        return held[key]

    return get


def encoded(df: DataFrame, id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, file: str = BYTE_BPE, out: str = "ids") -> DataFrame:
    """``id`` and ``out``, the list of ids of each row's text."""
    get = shared_encoder(df, folder, file)
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = get().encode
        for batch in batches:
            flat, ends = array.array("i"), [0]
            for t in batch.column(1).to_pylist():
                flat.extend(encode(t))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.array([], np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id), F.col("ids").alias(out))


def token_counts(df: DataFrame, keep: dict[str, str], text: str = "text", folder: str = TOKENIZERS, file: str = BYTE_BPE) -> DataFrame:
    """The columns of ``keep`` (name: SQL expression) and ``n_tokens`` of each row's text."""
    get = shared_encoder(df, folder, file)
    rows = df.select(*[F.expr(e).alias(n) for n, e in keep.items()], F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = get().encode
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, f"{kinds}, n_tokens long")
