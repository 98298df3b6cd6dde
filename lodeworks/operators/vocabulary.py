"""Vocabularies, encoding and balanced byte-pair training."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as T

SPECIALS = ("<pad>", "<bos>", "<eos>", "<unk>")
UNKNOWN = 3
#: Distinct units of all languages together that training collects; more is refused.
MAX_UNITS = 2_000_000


def vocabulary(d: DataFrame, text: str = "text") -> DataFrame:
    """``token`` and ``id`` in code-point order, after the special tokens."""
    found = d.select(F.explode(T.tokens(T.text_of(text))).alias("token")).distinct()
    order = found.withColumn("n", F.row_number().over(Window.partitionBy(F.substring("token", 1, 1)).orderBy("token")))
    heads = order.groupBy(F.substring("token", 1, 1).alias("head")).agg(F.max("n").alias("size"))
    starts = heads.select("head", F.coalesce(F.sum("size").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return order.join(starts, F.substring("token", 1, 1) == F.col("head")).select("token", (F.col("start") + F.col("n") + len(SPECIALS) - 1).alias("id"))


def encoded(d: DataFrame, vocab: DataFrame, id: str, text: str = "text") -> DataFrame:
    """``id`` and ``ids``, unknown tokens as ``UNKNOWN``; texts without tokens do not appear."""
    said = d.select(id, F.posexplode(T.tokens(T.text_of(text))).alias("i", "token"))
    pairs = said.join(vocab.withColumnRenamed("id", "v"), "token", "left").select(id, F.struct("i", F.coalesce("v", F.lit(UNKNOWN)).alias("v")).alias("p"))
    return pairs.groupBy(id).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]).alias("ids"))


def decoded(d: DataFrame, vocab: DataFrame, id: str) -> DataFrame:
    """``id`` and ``text``, tokens joined by blanks; unknown ids as U+FFFD."""
    said = d.select(id, F.posexplode("ids").alias("i", "v"))
    pairs = said.join(vocab.withColumnRenamed("id", "v"), "v", "left").select(id, F.struct("i", F.coalesce("token", F.lit("�")).alias("t")).alias("p"))
    return pairs.groupBy(id).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), " ").alias("text"))


def unit_counts(d: DataFrame, text: str = "text") -> DataFrame:
    """``lang``, ``unit``, ``n``."""
    return d.select("lang", F.explode(T.units(T.text_of(text))).alias("unit")).groupBy("lang", "unit").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(units: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``b``, ``n``: adjacent characters within units, weighted by the units' counts."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("unit") - 1), lambda i: F.substring("unit", i, F.lit(2)))
    rows = units.where(F.length("unit") > 1).select("lang", "n", F.explode(pairs).alias("p"))
    return rows.groupBy("lang", F.substring("p", 1, 1).alias("a"), F.substring("p", 2, 1).alias("b")).agg(F.sum("n").alias("n"))


@dataclass
class Merges:
    """Ids of symbols (0 unknown, then characters, then merges) and the merges in order."""

    symbols: list[str] = field(default_factory=list)
    merges: list[tuple[str, str]] = field(default_factory=list)

    def encoder(self):
        rank = {m: i for i, m in enumerate(self.merges)}
        ids = {s: i + 1 for i, s in enumerate(self.symbols)}

        def encode(unit: str) -> list[int]:
            parts = list(unit)
            while len(parts) > 1:
                best = min(zip(parts, parts[1:], strict=False), key=lambda p: rank.get(p, len(rank)))
                if best not in rank:
                    break
                parts = merge(parts, best)
            return [ids.get(p, 0) for p in parts]

        return encode


def merge(parts: list[str], pair: tuple[str, str]) -> list[str]:
    """Every occurrence of the pair joined, from the left, none overlapping."""
    out: list[str] = []
    i = 0
    while i < len(parts):
        if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
            out.append(parts[i] + parts[i + 1])
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


def train(units: DataFrame, merges: int) -> Merges:
    """Merges learned on the driver from distinct units, each from the language worst off.

    Worst off is the language of the most symbols per word; ties go to the first by name.
    Within it the commonest pair wins, ties by the ids of its parts.
    """
    if merges < 0:
        raise ValueError("merges must not be negative")
    rows = units.where(F.col("lang").isNotNull()).limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} distinct units; raise MAX_UNITS or cap the words per language")
    held: dict[str, list[tuple[list[str], int]]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["lang"], r["unit"])):
        held[r["lang"]].append((list(r["unit"]), r["n"]))
    model = Merges(sorted({c for seqs in held.values() for s, _ in seqs for c in s}))
    number = {s: i for i, s in enumerate(model.symbols)}
    words = {lang: sum(n for _, n in seqs) for lang, seqs in held.items()}
    size = {lang: sum(len(s) * n for s, n in seqs) for lang, seqs in held.items()}
    pairs = {lang: Counter() for lang in held}
    where: dict[str, dict] = {lang: defaultdict(set) for lang in held}
    for lang, seqs in held.items():
        for i, (s, n) in enumerate(seqs):
            for p in zip(s, s[1:], strict=False):
                pairs[lang][p] += n
                where[lang][p].add(i)
    for _ in range(merges):
        order = sorted(held, key=lambda k: (-size[k] / max(1, words[k]), k))
        lang = next((k for k in order if any(v > 0 for v in pairs[k].values())), None)
        if lang is None:
            break
        best = min((p for p, v in pairs[lang].items() if v > 0), key=lambda p: (-pairs[lang][p], number[p[0]], number[p[1]]))
        model.merges.append(best)
        joined = best[0] + best[1]
        if joined not in number:
            number[joined] = len(number)
            model.symbols.append(joined)
        for k, seqs in held.items():
            for i in list(where[k].get(best, ())):
                s, n = seqs[i]
                made = merge(s, best)
                if len(made) == len(s):
                    continue
                for p in zip(s, s[1:], strict=False):
                    pairs[k][p] -= n
                for p in zip(made, made[1:], strict=False):
                    pairs[k][p] += n
                    where[k][p].add(i)
                size[k] -= (len(s) - len(made)) * n
                seqs[i] = (made, n)
    return model


def bpe_encoded(d: DataFrame, model: Merges, id: str, text: str = "text") -> DataFrame:
    """``id`` and ``ids``; each distinct unit is encoded once and joined back."""
    said = d.select(id, F.posexplode(T.units(T.text_of(text))).alias("i", "unit"))
    shared = d.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        encode = shared.value.encoder()
        for batch in batches:
            units = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([encode(u) for u in units], pa.list_(pa.int32()))], names=["unit", "part"])

    coded = said.select("unit").distinct().mapInArrow(run, "unit string, part array<int>")
    rows = said.join(coded, "unit").select(id, F.struct("i", "part").alias("p"))
    return rows.groupBy(id).agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"])).alias("ids"))
