"""The consumption ledger: order, rollback, checkpoints, replay and audit, as queries over ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.registry import query

INTERVAL = 10


def events(e: DataFrame) -> DataFrame:
    """Each committed batch once, though it may have been appended twice."""
    return e.where("event = 'batch_committed'").dropDuplicates(["ledger_offset"])


_E = "e AS (SELECT DISTINCT ON (ledger_offset) * FROM ledger WHERE event = 'batch_committed')"
_SPANS = "spans AS (SELECT ledger_offset, run_branch_id, i, string_split(s, ':') AS p FROM (SELECT ledger_offset, run_branch_id, generate_subscripts(token_span_ids, 1) AS i, unnest(token_span_ids) AS s FROM e))"


@query("l01_event_counts", "ledger", sql="SELECT event, curriculum_stage, count(*) AS rows, count(DISTINCT ledger_offset) AS offsets FROM ledger GROUP BY ALL")
def event_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("event", "curriculum_stage").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ledger_offset").alias("offsets"))


@query("l03_rollback", "ledger", sql="SELECT coalesce(ledger_offset, -1) <= 3000 AS kept, count(*) AS n FROM ledger GROUP BY 1")
def rollback_counts(e: DataFrame) -> DataFrame:
    return e.groupBy((F.coalesce("ledger_offset", F.lit(-1)) <= 3000).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


def rolled_back(e: DataFrame, last: int) -> DataFrame:
    """Events up to and including an offset; events without one stay."""
    return e.where(F.coalesce("ledger_offset", F.lit(-1)) <= last)


@query("l04_checkpoints", "ledger", sql=f"WITH {_E} SELECT run_branch_id, ledger_offset, 'ckpt-' || run_branch_id || '-' || ledger_offset AS checkpoint FROM e WHERE (ledger_offset + 1) % {INTERVAL} = 0")
def checkpoints(e: DataFrame) -> DataFrame:
    return events(e).where(F.pmod(F.col("ledger_offset") + 1, F.lit(INTERVAL)) == 0).select("run_branch_id", "ledger_offset", F.concat_ws("-", F.lit("ckpt"), "run_branch_id", F.col("ledger_offset").cast("string")).alias("checkpoint"))


@query("w07_first_last", "ledger", sql=f"WITH {_E} SELECT run_branch_id, arg_min(checkpoint_id, ledger_offset) AS first, arg_max(checkpoint_id, ledger_offset) AS last, count(checkpoint_id) AS n FROM e WHERE checkpoint_id IS NOT NULL GROUP BY 1")
def first_last(e: DataFrame) -> DataFrame:
    return events(e).where("checkpoint_id is not null").groupBy("run_branch_id").agg(F.min_by("checkpoint_id", "ledger_offset").alias("first"), F.max_by("checkpoint_id", "ledger_offset").alias("last"), F.count("checkpoint_id").alias("n"))


@query("l07_crash_points", "ledger", sql=f"WITH {_E}, n AS (SELECT run_branch_id, count(*) AS commits FROM e GROUP BY 1) SELECT run_branch_id, commits, least({INTERVAL + INTERVAL // 2 - 1}, commits) AS crash_at, least({INTERVAL + INTERVAL // 2 - 1}, commits) // {INTERVAL} * {INTERVAL} AS resume_at FROM n")
def crash_points(e: DataFrame) -> DataFrame:
    crash = F.least(F.lit(INTERVAL + max(1, INTERVAL // 2) - 1).cast("long"), F.col("commits"))
    return events(e).groupBy("run_branch_id").agg(F.count(F.lit(1)).alias("commits")).select("run_branch_id", "commits", crash.alias("crash_at"), (F.floor(crash / INTERVAL) * INTERVAL).alias("resume_at"))


@query("l08_no_skip", "ledger", sql="SELECT count(*) AS n, count(DISTINCT ledger_offset) AS n_distinct, min(ledger_offset) AS low, max(ledger_offset) AS high, count(DISTINCT ledger_offset) = max(ledger_offset) + 1 AND min(ledger_offset) = 0 AS no_skip, count(*) = count(DISTINCT ledger_offset) AS no_repeat FROM ledger")
def no_skip(e: DataFrame) -> DataFrame:
    per = e.groupBy("ledger_offset").agg(F.count(F.lit(1)).alias("k"))
    whole = per.agg(F.sum("k").alias("n"), F.count("ledger_offset").alias("n_distinct"), F.min("ledger_offset").alias("low"), F.max("ledger_offset").alias("high"))
    return whole.select("*", ((F.col("n_distinct") == F.col("high") + 1) & (F.col("low") == 0)).alias("no_skip"), (F.col("n") == F.col("n_distinct")).alias("no_repeat"))


@query("w11_offset_gaps", "ledger", sql=f"WITH {_E} SELECT run_branch_id, ledger_offset, ledger_offset - lag(ledger_offset) OVER (PARTITION BY run_branch_id ORDER BY ledger_offset) AS gap FROM e")
def offset_gaps(e: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_branch_id").orderBy("ledger_offset")
    return events(e).select("run_branch_id", "ledger_offset", (F.col("ledger_offset") - F.lag("ledger_offset").over(w)).alias("gap"))


@query("w13_largest_drop", "ledger", sql=f"WITH {_E}, g AS (SELECT run_branch_id, ledger_offset, seq_len - lead(seq_len) OVER (PARTITION BY run_branch_id ORDER BY ledger_offset) AS fall FROM e) SELECT run_branch_id, max(fall) AS fall FROM g GROUP BY 1")
def largest_drop(e: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_branch_id").orderBy("ledger_offset")
    return events(e).withColumn("fall", F.col("seq_len") - F.lead("seq_len").over(w)).groupBy("run_branch_id").agg(F.max("fall").alias("fall"))


def spans(e: DataFrame) -> DataFrame:
    """One row per token span: ``ledger_offset``, ``run_branch_id``, ``i``, ``shard_id``, ``start``, ``end``."""
    rows = events(e).select("ledger_offset", "run_branch_id", F.posexplode("token_span_ids").alias("i", "span"))
    part = F.split("span", ":")
    return rows.select("ledger_offset", "run_branch_id", "i", part[0].alias("shard_id"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))


@query("w05_repeat_counter", "ledger", sql=f"WITH {_E}, {_SPANS} SELECT ledger_offset, i - 1 AS i, p[1] AS shard_id, row_number() OVER (PARTITION BY p[1] ORDER BY ledger_offset, i) - 1 AS repeats FROM spans")
def repeat_counter(e: DataFrame) -> DataFrame:
    w = Window.partitionBy("shard_id").orderBy("ledger_offset", "i")
    return spans(e).select("ledger_offset", F.col("i").cast("long").alias("i"), "shard_id", (F.row_number().over(w) - 1).cast("long").alias("repeats"))


@query("j06_span_lookup", "ledger", "manifest", sql=f"""WITH {_E}, {_SPANS}, m AS (SELECT shard_id, max(token_count) AS n FROM manifest GROUP BY 1)
SELECT ledger_offset, count(*) AS n_spans, count(n) AS n_known, sum(p[3]::BIGINT - p[2]::BIGINT)::BIGINT AS tokens, count(*) FILTER (WHERE p[3]::BIGINT > n) AS n_over FROM spans LEFT JOIN m ON m.shard_id = p[1] GROUP BY 1""")
def span_lookup(e: DataFrame, m: DataFrame) -> DataFrame:
    sizes = m.groupBy("shard_id").agg(F.max("token_count").alias("n"))
    return spans(e).join(sizes, "shard_id", "left").groupBy("ledger_offset").agg(
        F.count(F.lit(1)).alias("n_spans"), F.count("n").alias("n_known"), F.sum(F.col("end") - F.col("start")).alias("tokens"), F.count_if(F.col("end") > F.col("n")).alias("n_over")
    )


@query("l13_spans_match_shards", "ledger", sql=f"WITH {_E}, {_SPANS}, r AS (SELECT ledger_offset, string_agg(p[1], ',' ORDER BY i) AS shards FROM spans GROUP BY 1) SELECT e.ledger_offset, array_to_string(e.shard_ids, ',') = r.shards AS matched FROM e JOIN r USING (ledger_offset)")
def replay(e: DataFrame) -> DataFrame:
    rebuilt = spans(e).groupBy("ledger_offset").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "shard_id"))), lambda x: x["shard_id"]).alias("rebuilt"))
    return events(e).join(rebuilt, "ledger_offset").select("ledger_offset", (F.array_join("shard_ids", ",") == F.array_join("rebuilt", ",")).alias("matched"))


@query("l11_fork_modes", "ledger", sql=f"WITH {_E} SELECT ledger_offset, ledger_offset + 9 AS random_offset, ledger_offset + 17 AS fork_offset, CASE WHEN contains(run_branch_id, 'run-a') THEN replace(run_branch_id, 'run-a', 'run-b') ELSE run_branch_id || '-fork' END AS fork_branch, (ledger_offset + 9) % 80 AS schedule FROM e")
def fork_modes(e: DataFrame) -> DataFrame:
    branch = F.when(F.contains("run_branch_id", F.lit("run-a")), F.replace("run_branch_id", F.lit("run-a"), F.lit("run-b"))).otherwise(F.concat("run_branch_id", F.lit("-fork")))
    at = F.col("ledger_offset")
    return events(e).select("ledger_offset", (at + 9).alias("random_offset"), (at + 17).alias("fork_offset"), branch.alias("fork_branch"), F.pmod(at + 9, F.lit(80)).alias("schedule"))


@query("l12_audit", "ledger", sql=f"WITH {_E} SELECT ledger_offset // 1000 AS block, count(*) AS batches, array_to_string(list_sort(list(DISTINCT mixture_lane)), ',') AS lanes, array_to_string(list_sort(list(DISTINCT curriculum_stage)), ',') AS stages, count(DISTINCT opus_decision_id) AS decisions FROM e GROUP BY 1")
def audit(e: DataFrame) -> DataFrame:
    return events(e).groupBy(F.floor(F.col("ledger_offset") / 1000).alias("block")).agg(
        F.count(F.lit(1)).alias("batches"), F.array_join(F.array_sort(F.collect_set("mixture_lane")), ",").alias("lanes"), F.array_join(F.array_sort(F.collect_set("curriculum_stage")), ",").alias("stages"), F.countDistinct("opus_decision_id").alias("decisions")
    )


@query("f12_offset_range", "ledger", sql=f"WITH {_E} SELECT ledger_offset, run_branch_id FROM e WHERE ledger_offset >= 100 AND ledger_offset < 900")
def offset_range(e: DataFrame) -> DataFrame:
    return events(e).where((F.col("ledger_offset") >= 100) & (F.col("ledger_offset") < 900)).select("ledger_offset", "run_branch_id")


@query("l13_violations", "ledger", sql=f"""WITH {_E}, {_SPANS}, v AS (SELECT ledger_offset, bool_or(p[3]::BIGINT <= p[2]::BIGINT) AS empty_span, sum(p[3]::BIGINT - p[2]::BIGINT) AS used FROM spans GROUP BY 1)
SELECT e.ledger_offset, coalesce(v.empty_span, false) AS empty_span, coalesce(v.used, 0) > e.seq_len AS over_full, len(e.shard_ids) <> len(e.token_span_ids) AS uneven, length(coalesce(e.loss_mask_hash, '')) <> 64 AS bad_hash FROM e LEFT JOIN v USING (ledger_offset)""")
def violations(e: DataFrame) -> DataFrame:
    per = spans(e).groupBy("ledger_offset").agg(F.max(F.col("end") <= F.col("start")).alias("empty"), F.sum(F.col("end") - F.col("start")).alias("used"))
    return events(e).join(per, "ledger_offset", "left").select(
        "ledger_offset", F.coalesce("empty", F.lit(False)).alias("empty_span"), (F.coalesce("used", F.lit(0)) > F.col("seq_len")).alias("over_full"),
        (F.size("shard_ids") != F.size("token_span_ids")).alias("uneven"), (F.length(F.coalesce("loss_mask_hash", F.lit(""))) != 64).alias("bad_hash"),
    )


#: Points by which a lane's share may differ from the plan.
DRIFT = 8
_CHECKS = """
used AS (SELECT DISTINCT unnest(shard_ids) AS shard_id FROM e), v AS (SELECT ledger_offset, bool_or(p[3]::BIGINT <= p[2]::BIGINT) AS empty_span, sum(p[3]::BIGINT - p[2]::BIGINT) AS used, string_agg(p[1], ',' ORDER BY i) AS named FROM spans GROUP BY 1),
plan AS (SELECT lane, sum((band_hi - band_lo) * share_pct) AS planned FROM mixture GROUP BY 1), got AS (SELECT mixture_lane AS lane, count(*) AS n, sum(count(*)) OVER () AS total FROM e WHERE mixture_lane IS NOT NULL GROUP BY 1),
checks(requirement, detail) AS (
SELECT 'tokenizer_integrity', (SELECT count(DISTINCT tokenizer_hash) - 1 FROM manifest)
UNION ALL SELECT 'evaluation_firewall', (SELECT count(*) FROM used SEMI JOIN (SELECT shard_id FROM manifest WHERE eval_overlap_status IS DISTINCT FROM 'clear' AND admission = 'blocked') USING (shard_id))
UNION ALL SELECT 'data_cleaning', (SELECT count(*) FROM manifest WHERE starts_with(dedup_status, 'near_duplicate') AND admission = 'admitted')
UNION ALL SELECT 'packing_correctness', (SELECT count(*) FROM e LEFT JOIN v USING (ledger_offset) WHERE coalesce(empty_span, false) OR coalesce(used, 0) > seq_len OR len(shard_ids) <> len(token_span_ids) OR length(coalesce(loss_mask_hash, '')) <> 64)
UNION ALL SELECT 'mixture_compliance', (SELECT count(*) FROM plan LEFT JOIN got USING (lane) WHERE abs(coalesce(100.0 * n / total, 0) - planned) > 8)
UNION ALL SELECT 'decision_audit', (SELECT count(*) FROM e WHERE opus_decision_id IS NULL)
UNION ALL SELECT 'crash_recovery', (SELECT count(*) - count(DISTINCT ledger_offset) + max(ledger_offset) + 1 - count(DISTINCT ledger_offset) FROM ledger WHERE event = 'batch_committed')
UNION ALL SELECT 'replay', (SELECT count(*) FROM e JOIN v USING (ledger_offset) WHERE array_to_string(shard_ids, ',') <> named)
UNION ALL SELECT 'learning_trace', (SELECT count(*) FROM used ANTI JOIN manifest USING (shard_id))
UNION ALL SELECT 'throughput', (SELECT count(*) FROM e WHERE seq_len IS NULL OR seq_len <= 0 OR microbatch_count IS NULL OR microbatch_count <= 0))"""


@query("l15_evidence", "ledger", "manifest", "mixture", sql=f"WITH {_E}, {_SPANS}, {_CHECKS} SELECT requirement, detail::BIGINT AS detail, CASE WHEN detail = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM checks")
def evidence(e: DataFrame, m: DataFrame, x: DataFrame) -> DataFrame:
    """Ten requirements, each with how many rows speak against it; none may."""
    once = events(e)
    used = once.select(F.explode("shard_ids").alias("shard_id")).distinct()
    n = F.count(F.lit(1)).alias("detail")
    count = lambda df: df.agg(n)
    tripped = m.where(~F.col("eval_overlap_status").eqNullSafe("clear") & (F.col("admission") == "blocked")).select("shard_id").distinct()
    wrong = violations(e).where("empty_span or over_full or uneven or bad_hash")
    planned = x.groupBy("lane").agg(F.sum((F.col("band_hi") - F.col("band_lo")) * F.col("share_pct")).alias("planned"))
    got = once.where("mixture_lane is not null").groupBy(F.col("mixture_lane").alias("lane")).agg(F.count(F.lit(1)).alias("n"))
    total = got.agg(F.sum("n").alias("total"))
    drift = planned.join(got, "lane", "left").join(F.broadcast(total)).where(F.abs(F.coalesce(100.0 * F.col("n") / F.col("total"), F.lit(0.0)) - F.col("planned")) > DRIFT)
    committed = no_skip(e.where("event = 'batch_committed'"))
    checks = {
        "tokenizer_integrity": m.agg((F.countDistinct("tokenizer_hash") - 1).alias("detail")),
        "evaluation_firewall": count(used.join(tripped, "shard_id", "left_semi")),
        "data_cleaning": count(m.where(F.col("dedup_status").startswith("near_duplicate") & (F.col("admission") == "admitted"))),
        "packing_correctness": count(wrong),
        "mixture_compliance": count(drift),
        "decision_audit": count(once.where("opus_decision_id is null")),
        "crash_recovery": committed.select((F.col("n") - F.col("n_distinct") + F.col("high") + 1 - F.col("n_distinct")).alias("detail")),
        "replay": count(replay(e).where("not matched")),
        "learning_trace": count(used.join(m.select("shard_id").distinct(), "shard_id", "left_anti")),
        "throughput": count(once.where("seq_len is null or seq_len <= 0 or microbatch_count is null or microbatch_count <= 0")),
    }
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("requirement"), F.col("detail").cast("long").alias("detail"))
        out = row if out is None else out.union(row)
    return out.withColumn("result", F.when(F.col("detail") == 0, "PASS").otherwise("FAIL"))


@query("l16_evidence_markdown", "ledger", "manifest", "mixture")
def evidence_markdown(e: DataFrame, m: DataFrame, x: DataFrame) -> DataFrame:
    """The evidence as the lines of a Markdown table, in order."""
    rows = evidence(e, m, x).withColumn("line", F.concat(F.lit("| "), "requirement", F.lit(" | "), "result", F.lit(" | "), F.col("detail").cast("string"), F.lit(" |")))
    head = e.sparkSession.createDataFrame([(0, "| requirement | result | against |"), (1, "|---|---|---|")], "at int, line string")
    at = F.row_number().over(Window.orderBy("requirement")).cast("int") + 1  # ten rows
    return head.union(rows.select(at.alias("at"), "line"))


@query("j09_packed_mismatch", "ledger", sql="SELECT ledger_offset, count(*) AS times, count(DISTINCT coalesce(loss_mask_hash, '-') || array_to_string(token_span_ids, ',')) > 1 AS differs FROM ledger WHERE event = 'batch_committed' GROUP BY 1 HAVING count(*) > 1")
def packed_mismatch(e: DataFrame) -> DataFrame:
    """Offsets written more than once, and whether what was written differs."""
    what = F.concat(F.coalesce("loss_mask_hash", F.lit("-")), F.array_join("token_span_ids", ","))
    per = e.where("event = 'batch_committed'").groupBy("ledger_offset").agg(F.count(F.lit(1)).alias("times"), (F.min(what) != F.max(what)).alias("differs"))
    return per.where("times > 1")


@query("j11_unknown_shards", "ledger", "manifest", sql=f"WITH {_E} SELECT shard_id, count(*) AS n FROM (SELECT unnest(shard_ids) AS shard_id FROM e) ANTI JOIN manifest USING (shard_id) GROUP BY 1")
def unknown_shards(e: DataFrame, m: DataFrame) -> DataFrame:
    """Shards that batches name and no manifest knows."""
    per = events(e).select(F.explode("shard_ids").alias("shard_id")).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    return per.join(m.select("shard_id").distinct(), "shard_id", "left_anti")


@query("l05_checkpoint_records", "ledger", sql=f"WITH {_E} SELECT 'ckpt-' || run_branch_id || '-' || ledger_offset AS checkpoint_id, ledger_offset, 'ledger_offset_' || ledger_offset AS dataloader_state, sha256('{{\"loss\": 0, \"step\": ' || global_step || '}}') AS model_state_hash, sha256('{{\"lr\": 0.0003, \"step\": ' || global_step || '}}') AS optimizer_state_hash FROM e WHERE (ledger_offset + 1) % {INTERVAL} = 0")
def checkpoint_records(e: DataFrame) -> DataFrame:
    """A record per checkpoint, its states hashed as JSON with sorted keys."""
    at = F.col("ledger_offset").cast("string")
    state = lambda head: F.sha2(F.concat(F.lit(head), F.col("global_step").cast("string"), F.lit("}")), 256)
    due = events(e).where(F.pmod(F.col("ledger_offset") + 1, F.lit(INTERVAL)) == 0)
    return due.select(
        F.concat(F.lit("ckpt-"), "run_branch_id", F.lit("-"), at).alias("checkpoint_id"), "ledger_offset", F.concat(F.lit("ledger_offset_"), at).alias("dataloader_state"),
        state('{"loss": 0, "step": ').alias("model_state_hash"), state('{"lr": 0.0003, "step": ').alias("optimizer_state_hash"),
    )


@query("j08_trained_blocked", "ledger", "manifest", sql="SELECT DISTINCT shard_id FROM (SELECT unnest(shard_ids) AS shard_id FROM ledger) SEMI JOIN (SELECT shard_id FROM manifest WHERE admission = 'blocked') USING (shard_id)")
def trained_blocked(e: DataFrame, m: DataFrame) -> DataFrame:
    return e.select(F.explode("shard_ids").alias("shard_id")).distinct().join(m.where("admission = 'blocked'").select("shard_id").distinct(), "shard_id", "left_semi")


@query("j10_unlogged_shards", "manifest", "ledger", sql="SELECT DISTINCT shard_id FROM manifest ANTI JOIN (SELECT unnest(shard_ids) AS shard_id FROM ledger) USING (shard_id)")
def unlogged_shards(m: DataFrame, e: DataFrame) -> DataFrame:
    return m.select("shard_id").distinct().join(e.select(F.explode("shard_ids").alias("shard_id")).distinct(), "shard_id", "left_anti")


@query("j12_planned_vs_actual", "mixture", "ledger", sql=f"""WITH {_E}, t AS (SELECT curriculum_stage AS stage, mixture_lane AS lane, count(*) AS n FROM e WHERE mixture_lane IS NOT NULL GROUP BY ALL), s AS (SELECT stage, sum(n) AS total FROM t GROUP BY 1)
SELECT p.stage, p.lane, p.share_pct, coalesce(t.n, 0) AS n, coalesce(t.n * 10000 // s.total, 0)::BIGINT AS actual_10k FROM mixture p LEFT JOIN t USING (stage, lane) LEFT JOIN s ON s.stage = p.stage""")
def planned_vs_actual(p: DataFrame, e: DataFrame) -> DataFrame:
    got = events(e).where("mixture_lane is not null").groupBy(F.col("curriculum_stage").alias("stage"), F.col("mixture_lane").alias("lane")).agg(F.count(F.lit(1)).alias("n"))
    total = got.groupBy("stage").agg(F.sum("n").alias("total"))
    rows = p.join(got, ["stage", "lane"], "left").join(total, "stage", "left")
    return rows.select("stage", "lane", "share_pct", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.floor(F.col("n") * 10000 / F.col("total")), F.lit(0)).alias("actual_10k"))


@query("a06_decisions_histogram", "ledger", sql=f"WITH {_E} SELECT len(shard_ids) AS n_docs, position_policy, count(*) AS n FROM e GROUP BY ALL")
def documents_per_batch(e: DataFrame) -> DataFrame:
    return events(e).groupBy(F.size("shard_ids").cast("long").alias("n_docs"), "position_policy").agg(F.count(F.lit(1)).alias("n"))


@query("a09_utilization", "ledger", sql=f"WITH {_E}, {_SPANS}, u AS (SELECT ledger_offset, least(sum(p[3]::BIGINT - p[2]::BIGINT), 100000000)::BIGINT AS used FROM spans GROUP BY 1) SELECT position_policy AS policy, sum(least(used, seq_len))::BIGINT AS used, sum(seq_len)::BIGINT AS capacity FROM e JOIN u USING (ledger_offset) GROUP BY 1")
def utilization(e: DataFrame) -> DataFrame:
    per = spans(e).groupBy("ledger_offset").agg(F.sum(F.col("end") - F.col("start")).alias("used"))
    return events(e).join(per, "ledger_offset").groupBy(F.col("position_policy").alias("policy")).agg(F.sum(F.least("used", F.col("seq_len").cast("long"))).alias("used"), F.sum("seq_len").alias("capacity"))


@query("io05_late_events", "ledger", sql="SELECT run_branch_id, count(*) AS n, count(created_at) AS dated, min(created_at)::TIMESTAMP AS first FROM ledger GROUP BY 1")
def late_events(e: DataFrame) -> DataFrame:
    return e.groupBy("run_branch_id").agg(F.count(F.lit(1)).alias("n"), F.count("created_at").alias("dated"), F.min("created_at").alias("first"))


@query("stream_ledger", "ledger")
def stream_ledger(e: DataFrame) -> DataFrame:
    from lodeworks.streaming.ledger import committed_once

    return committed_once(e)
