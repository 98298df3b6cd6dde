"""Masking of structured personal data by ordered patterns, in built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import text as T

# The patterns, in the order in which they are masked.
URL = rf"https?://[^{T.WS}]+"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"
IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
PHONE = r"(?<![0-9])(?:\+?[0-9]{1,3}[-.\s]?)?\(?[2-9][0-9]{2}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}(?![0-9])|(?<![0-9])(?:\+91[\s-]?)?[6-9][0-9]{9}(?![0-9])"


def structured(text: Column, phones: bool = True) -> tuple[Column, dict[str, Column]]:
    """The masked text and the counts by kind, each taken after the masks before it."""
    counts: dict[str, Column] = {}
    for kind, pattern in (("url", URL), ("email", EMAIL), ("ip", IP), *((("phone", PHONE),) if phones else ())):
        counts[kind] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, f"[{kind.upper()}]")
    return text, counts


def totals(d: DataFrame, text: str = "text") -> DataFrame:
    """``kind`` and ``n`` over all texts."""
    _, counts = structured(T.text_of(text), phones=False)
    sums = d.select(*(c.alias(k) for k, c in counts.items())).agg(*(F.sum(k).alias(k) for k in counts))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in counts))))


def strict_kind(token: Column) -> Column:
    """The kind of one token by stricter patterns: email before ip before phone, else null."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    return (
        F.when(token.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), "email")
        .when(token.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), "ip")
        .when(token.rlike(r"^\+?[0-9][0-9().\s-]+[0-9]$") & digits.between(9, 13), "phone")
    )


def precision(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: how a recorded screening for e-mail addresses agrees with the texts."""
    _, counts = structured(T.text_of("text"), phones=False)
    has = texts.select("doc_id", (counts["email"] > 0).alias("has")).groupBy("doc_id").agg(F.max("has").alias("has"))
    said = manifest.select(F.col("doc_ids")[0].alias("doc_id"), (F.coalesce(F.col("pii_counts")["email"], F.lit(0)) > 0).alias("said"))
    return said.join(has, "doc_id").agg(F.count_if(F.col("said") & F.col("has")).alias("tp"), F.count_if(F.col("said") & ~F.col("has")).alias("fp"), F.count_if(~F.col("said") & F.col("has")).alias("fn"))


def names_masked(d: DataFrame, recogniser: Callable[[list[str]], list[list[tuple[int, int]]]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``text`` and ``n_names``: spans an injected recogniser finds, replaced from the right, batch by batch."""
    kind = d.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = iter(recogniser([t for t in texts if t is not None]))
            made, counts = [], []
            for t in texts:
                spans = next(found) if t is not None else []
                for start, end in sorted(spans, reverse=True):
                    t = t[:start] + "[NAME]" + t[end:]
                made.append(t)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string()), pa.array(counts, pa.int32())], names=["id", "text", "n_names"])

    rows = d.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text string, n_names int").withColumnRenamed("id", id)
