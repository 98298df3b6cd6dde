"""The cleaning run from raw documents to a corpus and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators import dedup, masking
from lodeworks.operators.cleaning import fully_normal
from lodeworks.runtime import Stage


def clean(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, span: int = 13, canary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The cleaned corpus (``id``, ``text``) and a report (``stage``, ``docs``, ``tokens``) of what each stage left.

    Texts are normalised in all five steps, kept if English and of good quality, freed of later near copies
    (first seen by id stays), masked, and dropped if they share ``span`` words with an
    item or hold the canary. Near copies are compared before masking, items after it.
    Null texts are taken as empty and fall to the quality stage; each id counts once.
    """
    stage = Stage(docs.sparkSession, "clean")
    raw = docs.groupBy(id).agg(F.max(T.text_of(text)).alias("text"))
    normal = stage.keep(fully_normal(raw, id).select(id, F.col("normal").alias("text")), "normal")
    good = stage.keep(normal.where(T.is_english(F.col("text")) & (F.size(T.quality_reasons(F.col("text"))) == 0)), "good")
    copies = dedup.classes(good, id).where(F.col(id) != F.col("rep")).select(id)
    later = dedup.greedy(dedup.jaccard_pairs(good, id, threshold=threshold).select("a", "b")).select(F.col("node").alias(id))
    unique = stage.keep(good.join(copies.union(later).distinct(), id, "left_anti"), "unique")
    hidden, _ = masking.structured(F.col("text"))
    masked = stage.keep(unique.select(id, hidden.alias("text")), "masked")
    clear = masked.join(dedup.contaminated(masked, items, span, id), id, "left_anti")
    clear = stage.keep(clear if canary is None else clear.where(~F.contains("text", F.lit(canary))), "clear")
    report = None
    for name, df in (("normalize", normal), ("filters", good), ("dedup", unique), ("mask", masked), ("decontaminate", clear)):
        row = df.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(T.n_words(F.col("text"))), F.lit(0)).alias("tokens")).select(F.lit(name).alias("stage"), "docs", "tokens")
        report = row if report is None else report.union(row)
    return clear, report
