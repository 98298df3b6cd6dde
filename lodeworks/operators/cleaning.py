"""Operators of the cleaning pipeline: DataFrame in, DataFrame out."""

from __future__ import annotations

import html
import random
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as T

#: Rows of one range of a distributed running total.
RANGE = 10_000


def normalize_stats(d: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents changed, characters removed, noise characters of the raw texts."""
    raw = T.text_of(text)
    made, _ = T.normalized(raw)
    return d.select(raw.alias("raw"), made.alias("made")).agg(
        F.count_if(F.col("made") != F.col("raw")).alias("docs_modified"),
        F.sum(F.greatest(F.lit(0), F.length("raw") - F.length("made"))).alias("chars_removed"),
        F.sum(F.length("raw") - F.length(T.strip_noise(F.col("raw")))).alias("zero_width_removed"),
    )


def fully_normal(d: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``raw``, ``normal`` and ``ops``: all five steps, the two that need Python in one pass of Arrow batches.

    Entities are resolved and characters composed first, then noise and control characters
    go, then white space is collapsed; ``ops`` names the steps that changed something. A
    null text counts as empty.
    """
    kind = d.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or "" for t in batch.column(1).to_pylist()]
            plain = [html.unescape(t) if "&" in t else t for t in raw]
            made = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in plain]
            said = [[n for n, c in (("html_unescape", a != b), ("nfc", b != c)) if c] for a, b, c in zip(raw, plain, made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.string()), pa.array(made, pa.string()), pa.array(said, pa.list_(pa.string()))], names=["id", "raw", "made", "said"])

    rows = d.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, raw string, made string, said array<string>")
    normal, ops = T.normalized(F.col("made"))
    return rows.select(F.col("id").alias(id), "raw", normal.alias("normal"), F.concat("said", ops).alias("ops"))


def top_bigram(d: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document of two characters or more: count of the commonest character bigram, and of all."""
    raw = T.text_of(text)
    pairs = F.transform(F.sequence(F.lit(1), F.length(raw) - 1), lambda i: F.substring(raw, i, F.lit(2)))
    per = d.where(F.length(raw) > 1).select(id, F.explode(pairs).alias("b")).groupBy(id, "b").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(id).agg(F.max("n").alias("top"), F.sum("n").alias("total"))


ROLE = r"^(user|plan|tool_call|observation|response): (.*)$"


def turns(d: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The lines of a text that carry a role, numbered: ``i``, ``role``, ``said``."""
    rows = d.select(id, F.posexplode(F.split(T.text_of(text), "\n")).alias("i", "line")).where(F.col("line").rlike(ROLE))
    return rows.select(id, "i", F.regexp_extract("line", ROLE, 1).alias("role"), F.regexp_extract("line", ROLE, 2).alias("said"))


def conversations(d: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Conversations in one dialect: a role marker before each turn, an end marker after the last."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "role", "said"))), lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>"), t["said"]))
    return turns(d, id, text).groupBy(id).agg(F.concat(F.array_join(listed, ""), F.lit("<|end|>")).alias("rendered"), F.count(F.lit(1)).alias("n_turns"))


# The markers of four ways to write a conversation, and what each becomes.
DIALECTS = (("bracket", r"\[(?:USER|ASSISTANT|SYSTEM)\]"), ("tag", r"</?(?:USER|ASSISTANT|SYSTEM)>"), ("instruction", r"### (?:Instruction|Response):"), ("header", r"### (?:Topic|Question):"))
UNIFIED = (
    (r"</(?:USER|ASSISTANT|SYSTEM)>", ""), (r"\[USER\]|<USER>|### Instruction:|### Question:", "<|user|>"), (r"\[ASSISTANT\]|<ASSISTANT>|### Response:", "<|assistant|>"),
    (r"\[SYSTEM\]|<SYSTEM>", "<|system|>"), (r"### Topic:", "<|system|>Topic:"),
)


def unified_dialects(d: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``dialects`` (those whose markers a text has), ``n_markers``, ``unified``: one marker per role and an end mark.

    A text without markers stays as it is.
    """
    raw = T.text_of(text)
    counts = {name: F.regexp_count(raw, F.lit(pattern)) for name, pattern in DIALECTS}
    found = F.array_compact(F.array(*(F.when(c > 0, F.lit(name)) for name, c in counts.items())))
    total = sum(counts.values(), F.lit(0))
    made = raw
    for pattern, to in UNIFIED:
        made = F.regexp_replace(made, pattern, to.replace("$", "\\$"))
    return d.select(id, F.array_join(found, ",").alias("dialects"), total.cast("long").alias("n_markers"), F.when(total > 0, F.concat(made, F.lit("<|end|>"))).otherwise(raw).alias("unified"))


def windows(d: DataFrame, id: str = "doc_id", text: str = "text", size: int = 800) -> DataFrame:
    """Windows of at most ``size`` characters, cut at the last blank: ``window``, ``start``, ``piece``."""
    kind = d.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, starts, pieces = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = n = 0
                while t and at < len(t):
                    end = at + size
                    if end < len(t):
                        blank = t.rfind(" ", at + 1, end)
                        end = blank if blank > at else end
                    ids.append(i)
                    numbers.append(n)
                    starts.append(at)
                    pieces.append(t[at:end])
                    at, n = end, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(pieces, pa.string())], names=["id", "window", "start", "piece"])

    return d.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, window int, start int, piece string").withColumnRenamed("id", id)


def marked(d: DataFrame, canary: str, text: str = "text") -> DataFrame:
    """The table with ``marked``: whether the text holds the canary."""
    return d.withColumn("marked", F.contains(T.text_of(text), F.lit(canary)))


def probes(d: DataFrame, text: str = "text") -> DataFrame:
    """One row: how many documents show each sign of dirt."""
    raw = T.text_of(text)
    noise = f"[{T.NOISE}]"
    return d.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(raw.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+")).alias("email"),
        F.count_if(F.contains(raw, F.lit("|"))).alias("pipe"),
        F.count_if(F.length(raw) < 200).alias("tiny"),
        F.count_if(raw.rlike(noise)).alias("zero_width"),
        F.count_if(raw.rlike("&[a-z]+;")).alias("entity"),
    )


def funnel(d: DataFrame, text: str = "text") -> DataFrame:
    """Documents and words left after each stage, from one aggregate over distinct texts.

    The flags depend on the text alone, so copies are counted, not kept apart, and a text
    that a third of the rows share is one pre-aggregated group.
    """
    raw = d.select(T.text_of(text).alias("raw"))
    flags = raw.select(F.md5("raw").alias("key"), T.n_words(F.col("raw")).alias("t"), T.is_english(F.col("raw")).alias("p1"), (F.size(T.quality_reasons(F.col("raw"))) == 0).alias("p2"))
    per = flags.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    kept: dict[str, tuple[Column, Column]] = {
        "load": (F.lit(True), F.col("n")), "langid": (F.col("p1"), F.col("n")), "quality": (F.col("p1") & F.col("p2"), F.col("n")), "exact_dedup": (F.col("p1") & F.col("p2"), F.lit(1).cast("long")),
    }
    sums = per.agg(*(F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(f"d_{s}") for s, (c, n) in kept.items()), *(F.sum(F.when(c, n * F.col("t"))).alias(f"t_{s}") for s, (c, n) in kept.items()))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"d_{s}").alias("docs"), F.col(f"t_{s}").alias("tokens")) for s in kept))))


def running(d: DataFrame, order: str, value: str, ranges: int = 64) -> DataFrame:
    """``order``, ``value`` and ``before``, the sum of ``value`` over all earlier rows.

    Rows are put in ranges of ``order`` (quantiles of all of it); sums per range are added
    up over the few ranges, and running sums are taken within a range, so no task holds
    the table.
    """
    cuts = d.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first()["c"] or []
    cut = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array(F.lit(0))
    placed = d.select(order, value, F.size(F.filter(cut, lambda c: c < F.col(order))).alias("range"))
    sums = placed.groupBy("range").agg(F.sum(value).alias("s"))
    starts = sums.select("range", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(starts), "range").select(order, value, (F.col("start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("before"))


def budget_prefix(d: DataFrame, order: str, value: str, budget: int) -> DataFrame:
    """The first rows whose earlier rows sum to less than the budget; the one that crosses it stays."""
    return running(d, order, value).where(F.col("before") < budget).select(order, F.col("before").alias("running"))


def numbered(d: DataFrame, order: str) -> DataFrame:
    """``order`` and ``row``, its number from 0 on."""
    return running(d.select(order).withColumn("_one", F.lit(1)), order, "_one").select(order, F.col("before").alias("row"))


def seeded_sample(d: DataFrame, order: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, drawn by a seeded generator over row numbers."""
    n = d.count()
    picks = d.sparkSession.createDataFrame([(i,) for i in random.Random(seed).sample(range(n), min(k, n))], "row long")
    return numbered(d, order).join(F.broadcast(picks), "row").select(order)
