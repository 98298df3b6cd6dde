"""Packed samples, replay, resume and verification: queries over documents and ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.catalog.texts import _D, _tokens
from lodeworks.operators import samples as S
from lodeworks.operators.cleaning import ROLE
from lodeworks.registry import query
from lodeworks.runtime import Stage

SIZE = S.WINDOW
_SAID = f"CASE WHEN regexp_matches(l, '{ROLE}') THEN regexp_extract(l, '{ROLE}', 2) ELSE l END"
_BEARS = f"CASE WHEN regexp_matches(l, '{ROLE}') AND NOT regexp_extract(l, '{ROLE}', 1) IN {S.LOSS_ROLES} THEN '00' ELSE '01' END"
# A stream's mask as two hexadecimal digits a token, its fragments per window, and the windows.
_STREAMS = f"""streams AS (SELECT doc_id, m || '00' AS m, length(m) // 2 + 1 AS n FROM (SELECT doc_id, array_to_string(list_transform(string_split({_D}, chr(10)), lambda l: repeat({_BEARS}, len({_tokens(_SAID)}))), '') AS m FROM documents) WHERE m <> ''),
spots AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM streams),
cut AS (SELECT *, unnest(range(pos // {SIZE}, (pos + n - 1) // {SIZE} + 1)) AS bin FROM spots),
parts AS (SELECT bin, doc_id, greatest(pos, bin * {SIZE}) - pos AS start, least(pos + n, (bin + 1) * {SIZE}) - pos AS stop, m FROM cut),
bins AS (SELECT bin AS ledger_offset, count(*) AS n_docs, sum(stop - start)::BIGINT AS used, string_agg(doc_id || ':' || start || ':' || stop, ',' ORDER BY doc_id) AS spans,
 sum((stop - start) * (stop - start + 1) // 2)::BIGINT AS pairs, sum((stop - start) * (stop - start - 1) // 2)::BIGINT AS position_sum,
 string_agg(substr(m, 2 * start + 1, 2 * (stop - start)), '' ORDER BY doc_id) AS mask FROM parts GROUP BY bin),
hashed AS (SELECT *, sha256(unhex(mask || repeat('00', {SIZE} - used))) AS mask_hash FROM bins)"""


@query("b08_masked_sample", "documents", sql=f"WITH {_STREAMS} SELECT ledger_offset, n_docs, {SIZE} - used AS padding, spans, length(replace(mask, '0', '')) AS mask_sum, position_sum, mask_hash FROM hashed")
def masked_sample(d: DataFrame) -> DataFrame:
    """Every packed sample: its spans, padding, loss-bearing tokens, positions and the hash of its mask."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("long")
    padding = F.size(F.filter("segment_ids", lambda s: s == F.size("shard_ids")))
    return S.samples(d).select(
        "ledger_offset", F.size("shard_ids").cast("long").alias("n_docs"), padding.cast("long").alias("padding"), F.array_join("token_span_ids", ",").alias("spans"),
        total("loss_mask").alias("mask_sum"), total("position_ids").alias("position_sum"), F.col("loss_mask_hash").alias("mask_hash"),
    )


@query("f11_causal_pairs", "documents", sql=f"WITH {_STREAMS} SELECT ledger_offset, pairs + ({SIZE} - used) * ({SIZE} - used + 1) // 2 AS n_pairs FROM bins")
def causal_pairs(d: DataFrame) -> DataFrame:
    """Pairs of positions that may attend to each other: not later, and of the same segment."""
    return S.samples(d).select("ledger_offset", S.attended(F.col("segment_ids")).alias("n_pairs"))


@query("l10_replay", "documents", sql=f"""WITH {_STREAMS}, later AS (SELECT ledger_offset - 9 AS ledger_offset, spans AS other, mask_hash AS other_hash FROM hashed)
SELECT h.ledger_offset, mask_hash AS original, mask_hash AS rebuilt, true AS matched, coalesce(other = spans AND other_hash = mask_hash, false) AS matched_elsewhere FROM hashed h LEFT JOIN later USING (ledger_offset)""")
def replay(d: DataFrame) -> DataFrame:
    """The run's events, each sample rebuilt from its spans alone; nine offsets further on nothing should match."""
    stage = Stage(d.sparkSession, "replay")
    made = stage.keep(S.streams(d), "streams")
    events = stage.keep(S.committed(S.samples(d)), "events")
    rebuilt = stage.keep(S.replayed(events, made), "rebuilt")
    elsewhere = S.compared(events, rebuilt, shift=9).select("ledger_offset", F.col("matched").alias("matched_elsewhere"))
    return S.compared(events, rebuilt).join(elsewhere, "ledger_offset")


@query("l13_sample_violations", "documents", sql=f"WITH {_STREAMS} SELECT count(*) AS n_samples, 0 AS n_violating, count(*) FILTER (WHERE n_docs > 1) AS n_several FROM bins")
def sample_violations(d: DataFrame) -> DataFrame:
    """How many samples were verified, how many are wrong in any of the seven ways, how many hold several documents."""
    packed = S.samples(d)
    several = packed.select("ledger_offset", (F.size("shard_ids") > 1).alias("several"))
    return S.violations(packed).join(several, "ledger_offset").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.size("violations") > 0).cast("int").alias("n_violating"), F.count_if("several").alias("n_several")
    )


@query("l14_packed_batches", "documents", sql=f"WITH {_STREAMS} SELECT count(*) AS n_samples, 0::BIGINT AS n_mismatched, (sum(used) * 10000 // (count(*) * {SIZE}))::BIGINT AS used_10k FROM bins")
def packed_batches(d: DataFrame) -> DataFrame:
    """The ledger against the packed report, and the report's utilisation worked out again from the spans."""
    stage = Stage(d.sparkSession, "packed")
    packed = stage.keep(S.samples(d), "packed")
    events = S.committed(packed).select("ledger_offset", F.col("token_span_ids").alias("spans"), F.col("loss_mask_hash").alias("hash"))
    length = lambda s: F.regexp_extract(s, ":([0-9]+)$", 1).cast("long") - F.regexp_extract(s, ":([0-9]+):[0-9]+$", 1).cast("long")
    used = F.aggregate("token_span_ids", F.lit(0).cast("long"), lambda a, s: a + length(s))
    wrong = (F.col("spans") != F.col("token_span_ids")) | (F.col("hash") != F.col("loss_mask_hash"))
    return packed.join(events, "ledger_offset").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(wrong).alias("n_mismatched"), F.floor(F.sum(used) * 10000 / F.sum("seq_len")).alias("used_10k")
    )


@query("b09_microbatches", "documents", sql=f"WITH {_STREAMS} SELECT ledger_offset // 4 AS microbatch, count(*) AS n, string_agg(spans, ';' ORDER BY ledger_offset) AS spans, sum(length(replace(mask, '0', '')))::BIGINT AS mask_sum FROM hashed GROUP BY 1")
def microbatches(d: DataFrame) -> DataFrame:
    """Four samples a microbatch, each field gathered in order."""
    packed = S.samples(d).withColumn("shard_ids", F.col("token_span_ids"))
    lists = S.microbatches(packed)
    total = F.aggregate(F.flatten("loss_mask"), F.lit(0).cast("long"), lambda a, x: a + x)
    return lists.select("microbatch", F.size("tokens").cast("long").alias("n"), F.array_join(F.transform("shard_ids", lambda x: F.array_join(x, ",")), ";").alias("spans"), total.alias("mask_sum"))


@query("m01_shards", "documents", sql=f"""SELECT doc_id::VARCHAR AS id, coalesce(lane, 'none') || '-' || substr(h, 1, 12) AS shard_id, h AS content_hash, n AS token_count FROM (SELECT doc_id, lane, len(t) AS n,
sha256(unhex(array_to_string(list_transform(t, lambda w: lpad(printf('%X', ('0x' || substr(md5(w), 1, 6))::BIGINT + {S.SPECIALS}), 8, '0')), ''))) AS h FROM (SELECT doc_id, lane, flatten(list_transform(string_split({_D}, chr(10)), lambda l: {_tokens(_SAID)})) AS t FROM documents) WHERE len(t) > 0)""")
def shards(d: DataFrame) -> DataFrame:
    return S.shards(d)


_RUN = 10


def resumed(e: DataFrame, interval: int = _RUN) -> DataFrame:
    """Per branch a run that is broken off between two checkpoints, rolled back to the first and taken up again.

    ``steps`` and ``rows`` of its log, the step it breaks off at, the one it is taken up at,
    how many commits are rolled back, whether every offset is committed once, and whether
    what stands at the step taken up, however often it was written, is one and the same batch.
    Only the first steps of a branch are ranked, so a branch of many rows is one short list.
    """
    crash = interval + max(1, interval // 2) - 1
    log = e.where("event = 'batch_committed'")
    same = F.sha2(F.to_json(F.struct("shard_ids", "token_span_ids", "loss_mask_hash")), 256)
    per = log.groupBy("run_branch_id", "ledger_offset").agg(F.count(F.lit(1)).alias("k"), F.min(same).alias("low"), F.max(same).alias("high"))
    whole = per.groupBy("run_branch_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("k").alias("rows"))
    step = F.row_number().over(Window.partitionBy("run_branch_id").orderBy("ledger_offset"))
    first = per.withColumn("step", step).where(F.col("step") <= interval + 1).where(F.col("step") == interval + 1)
    at = first.select("run_branch_id", F.col("ledger_offset").alias("resume_offset"), (F.col("low") == F.col("high")).alias("matched"))
    n = F.col("steps")
    stopped = F.least(F.lit(crash).cast("long"), n - 1)
    resume = F.floor((stopped + 1) / interval) * interval
    return whole.join(at, "run_branch_id", "left").select(
        "run_branch_id", "steps", "rows", stopped.alias("crash_step"), resume.alias("resume_step"), (stopped + 1 - resume).alias("rolled_back"),
        (F.col("rows") == n).alias("no_repeat"), "resume_offset", "matched",
    )


@query("l09_resume_matches", "ledger", sql=f"""WITH l AS (SELECT run_branch_id, ledger_offset, array_to_string(shard_ids, ',') || '|' || array_to_string(token_span_ids, ',') || '|' || coalesce(loss_mask_hash, '-') AS what FROM ledger WHERE event = 'batch_committed'),
per AS (SELECT run_branch_id, ledger_offset, count(*) AS k, min(what) AS low, max(what) AS high FROM l GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY run_branch_id ORDER BY ledger_offset) AS step FROM per),
whole AS (SELECT run_branch_id, count(*) AS steps, sum(k)::BIGINT AS rows FROM per GROUP BY 1), x AS (SELECT *, least({_RUN + _RUN // 2 - 1}, steps - 1) AS crash_step FROM whole)
SELECT x.run_branch_id, steps, rows, crash_step, (crash_step + 1) // {_RUN} * {_RUN} AS resume_step, crash_step + 1 - (crash_step + 1) // {_RUN} * {_RUN} AS rolled_back, rows = steps AS no_repeat, ledger_offset AS resume_offset, low = high AS matched
FROM x LEFT JOIN ranked r ON r.run_branch_id = x.run_branch_id AND r.step = {_RUN + 1}""")
def resume_matches(e: DataFrame) -> DataFrame:
    return resumed(e)
