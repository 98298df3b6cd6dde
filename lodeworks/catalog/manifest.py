"""Shard manifests: gates, validation, scores and admission, as queries over manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.registry import query

# Licences that block a shard, and the weight of each tier.
UNSAFE = ("", "unknown", "unsafe", "none", "proprietary")
TIERS = {"safe": 100, "review": 60}


def gates(limit: float = 25.0) -> Column:
    """Reasons to keep a shard from training, in a fixed order; absent flags count as clear."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return F.array_compact(F.array(
        F.when(flag("never_train"), F.lit("never_train")),
        F.when(F.coalesce("benchmark_overlap_pct", F.lit(0.0)) > limit, F.lit("benchmark_overlap_exceeded")),
        F.when(flag("canary_match"), F.lit("canary_match")),
        F.when(flag("benchmark_derived"), F.lit("benchmark_derived")),
    ))


_GATES = "array_to_string(list_filter([CASE WHEN never_train THEN 'never_train' END, CASE WHEN benchmark_overlap_pct > 25 THEN 'benchmark_overlap_exceeded' END, CASE WHEN canary_match THEN 'canary_match' END, CASE WHEN benchmark_derived THEN 'benchmark_derived' END], lambda x: x IS NOT NULL), ',')"
_UNSAFE = f"lower(trim(coalesce(license_tier, ''))) IN {UNSAFE}"
_MISSING = "array_to_string(list_filter([CASE WHEN coalesce(license_tier, '') = '' THEN 'license_tier' END, CASE WHEN coalesce(cleaning_pipeline_hash, '') = '' THEN 'cleaning_pipeline_hash' END, CASE WHEN coalesce(token_count, 0) <= 0 THEN 'token_count' END], lambda x: x IS NOT NULL), ',')"
_TRIPPED = "(eval_overlap_status IS DISTINCT FROM 'clear')"
_SCORE = f"(CASE WHEN m <> '' OR u OR t THEN least(s, 6400) ELSE s END)"
_SCORED = f"""SELECT *, {_SCORE} AS score FROM (SELECT *, 2600 * (3 - CASE WHEN m = '' THEN 0 ELSE len(string_split(m, ',')) END) + 22 * (CASE lower(coalesce(license_tier, '')) WHEN 'safe' THEN 100 WHEN 'review' THEN 60 ELSE 0 END) AS s
FROM (SELECT *, {_MISSING} AS m, {_UNSAFE} AS u, {_TRIPPED} AS t FROM manifest))"""


@query("f08_firewall", "manifest", sql=f"SELECT r AS reasons, r = '' AS passed, count(*) AS n FROM (SELECT {_GATES} AS r FROM manifest) GROUP BY ALL")
def firewall(m: DataFrame) -> DataFrame:
    return m.groupBy(F.array_join(gates(), ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n")).select("reasons", (F.col("reasons") == "").alias("passed"), "n")


def unsafe() -> Column:
    return F.lower(F.trim(F.coalesce("license_tier", F.lit("")))).isin(*UNSAFE)


def missing() -> Column:
    """Hard-required fields that a shard lacks."""
    return F.array_compact(F.array(
        F.when(F.coalesce("license_tier", F.lit("")) == "", F.lit("license_tier")),
        F.when(F.coalesce("cleaning_pipeline_hash", F.lit("")) == "", F.lit("cleaning_pipeline_hash")),
        F.when(F.coalesce("token_count", F.lit(0)) <= 0, F.lit("token_count")),
    ))


def tripped() -> Column:
    """An overlap status other than clear trips, an absent one too."""
    return ~F.col("eval_overlap_status").eqNullSafe("clear")


@query("m03_manifest_validation", "manifest", sql=f"SELECT license_tier, {_MISSING} AS missing, {_UNSAFE} AS unsafe, ({_MISSING} <> '' OR {_UNSAFE}) AS blocked, count(*) AS n FROM manifest GROUP BY ALL")
def validation(m: DataFrame) -> DataFrame:
    rows = m.select("license_tier", F.array_join(missing(), ",").alias("missing"), unsafe().alias("unsafe"))
    return rows.groupBy("license_tier", "missing", "unsafe").agg(F.count(F.lit(1)).alias("n")).withColumn("blocked", (F.col("missing") != "") | F.col("unsafe"))


def scored(m: DataFrame) -> DataFrame:
    """The manifest with ``m``, ``u``, ``t`` (missing, unsafe, tripped) and ``score`` in hundredths of a point."""
    tier = F.lower(F.coalesce("license_tier", F.lit("")))
    weight = F.when(tier == "safe", TIERS["safe"]).when(tier == "review", TIERS["review"]).otherwise(0)
    rows = m.withColumns({"m": missing(), "u": unsafe(), "t": tripped()})
    s = 2600 * (3 - F.size("m")) + 22 * weight
    return rows.withColumn("score", F.when((F.size("m") > 0) | F.col("u") | F.col("t"), F.least(s, F.lit(6400))).otherwise(s))


@query("m04_admission_score", "manifest", sql=f"SELECT score, m <> '' OR u OR t AS hard_blocked, count(*) AS n FROM ({_SCORED}) GROUP BY ALL")
def admission_score(m: DataFrame) -> DataFrame:
    hard = (F.size("m") > 0) | F.col("u") | F.col("t")
    return scored(m).groupBy(F.col("score").cast("long").alias("score"), hard.alias("hard_blocked")).agg(F.count(F.lit(1)).alias("n"))


_ADMIT = "CASE WHEN u THEN 'blocked' WHEN t THEN 'blocked' WHEN starts_with(coalesce(dedup_status, ''), 'near_duplicate') THEN 'blocked' WHEN m <> '' THEN 'held_for_review' WHEN score > 8600 THEN 'admitted' ELSE 'held_for_review' END"


@query("m06_admission", "manifest", sql=f"SELECT decided, admission AS recorded, count(*) AS n FROM (SELECT *, {_ADMIT} AS decided FROM ({_SCORED})) GROUP BY ALL")
def admission(m: DataFrame) -> DataFrame:
    near = F.coalesce("dedup_status", F.lit("")).startswith("near_duplicate")
    decided = F.when(F.col("u") | F.col("t") | near, "blocked").when(F.size("m") > 0, "held_for_review").when(F.col("score") > 8600, "admitted").otherwise("held_for_review")
    return scored(m).groupBy(decided.alias("decided"), F.col("admission").alias("recorded")).agg(F.count(F.lit(1)).alias("n"))


@query("m07_assembly", "manifest", "run_pipeline", sql="""SELECT shard_id, token_count, doc_ids[1] AS doc_id, length(text) AS n_chars, CASE WHEN list_sum(map_values(pii_counts)) > 0 THEN 'masked' ELSE 'clean' END AS screen
FROM (SELECT DISTINCT shard_id, token_count, doc_ids, pii_counts FROM manifest) LEFT JOIN (SELECT DISTINCT doc_id, text FROM run_pipeline) r ON r.doc_id = doc_ids[1]""")
def assembly(m: DataFrame, d: DataFrame) -> DataFrame:
    total = F.aggregate(F.map_values("pii_counts"), F.lit(0), lambda a, x: a + x)
    screen = F.when(total > 0, "masked").otherwise("clean")
    rows = m.select("shard_id", "token_count", F.col("doc_ids")[0].alias("doc_id"), F.array_join(F.transform(F.array_sort(F.map_entries("pii_counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("pii"), screen.alias("screen")).distinct()
    texts = d.select("doc_id", F.length("text").cast("long").alias("n_chars")).distinct()
    return rows.join(texts, "doc_id", "left").select("shard_id", "token_count", "doc_id", "n_chars", "screen")


@query("m08_lineage_verdict", "manifest", sql="SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN license_tier = 'unsafe' THEN 'blocked' WHEN license_tier IS NULL OR cleaning_pipeline_hash IS NULL OR token_count IS NULL OR capability_lane IS NULL OR tokenizer_hash IS NULL OR content_hash IS NULL THEN 'incomplete' ELSE 'ok' END AS verdict FROM manifest) GROUP BY 1")
def lineage_verdict(m: DataFrame) -> DataFrame:
    fields = ("license_tier", "cleaning_pipeline_hash", "token_count", "capability_lane", "tokenizer_hash", "content_hash")
    absent = F.exists(F.array(*(F.col(c).isNull() for c in fields)), lambda x: x)
    return m.groupBy(F.when(F.coalesce(F.col("license_tier") == "unsafe", F.lit(False)), "blocked").when(absent, "incomplete").otherwise("ok").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("m02_corpus_manifest", "documents", sql="SELECT source, count(*) AS doc_count, coalesce(sum(n_chars), 0)::BIGINT AS chars, count(DISTINCT lower(lang)) AS languages, min(doc_id) AS first_id FROM documents GROUP BY source")
def corpus_manifest(d: DataFrame) -> DataFrame:
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.countDistinct(F.lower("lang")).alias("languages"), F.min("doc_id").alias("first_id"))


@query("j04_admitted_by_lane", "manifest", sql="SELECT lower(trim(capability_lane)) AS lane, count(*) AS n, coalesce(sum(token_count), 0)::BIGINT AS tokens FROM manifest WHERE admission = 'admitted' GROUP BY 1")
def admitted_by_lane(m: DataFrame) -> DataFrame:
    return m.where("admission = 'admitted'").groupBy(F.lower(F.trim("capability_lane")).alias("lane")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))


@query("j05_duplicate_lookup", "manifest", sql="""WITH named AS (SELECT DISTINCT shard_id, substr(dedup_status, 19) AS of_id FROM manifest WHERE starts_with(dedup_status, 'near_duplicate_of:'))
SELECT of_id IS NOT NULL AS named, k IS NOT NULL AS known, count(*) AS n FROM named LEFT JOIN (SELECT DISTINCT shard_id AS k FROM manifest) ON k = of_id GROUP BY ALL""")
def duplicate_lookup(m: DataFrame) -> DataFrame:
    named = m.where(F.col("dedup_status").startswith("near_duplicate_of:")).select("shard_id", F.expr("substr(dedup_status, 19)").alias("of_id")).distinct()
    known = m.select(F.col("shard_id").alias("k")).distinct()
    return named.join(known, F.col("k") == F.col("of_id"), "left").groupBy(F.col("of_id").isNotNull().alias("named"), F.col("k").isNotNull().alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("a04_lane_shares", "manifest", "run_pipeline", sql="""WITH s AS (SELECT doc_id, max(octet_length(encode(text))) AS bytes FROM run_pipeline WHERE text IS NOT NULL GROUP BY 1),
r AS (SELECT coalesce(lower(trim(capability_lane)), 'none') AS lane, token_count AS n, token_count > 0 AND (bytes IS NULL OR token_count <= bytes) AS fit FROM manifest LEFT JOIN s ON s.doc_id = doc_ids[1])
SELECT lane, t AS tokens, t * 10000 // sum(t) OVER () AS per_10k, left_out FROM (SELECT lane, coalesce(sum(n) FILTER (WHERE fit), 0)::BIGINT AS t, count(*) FILTER (WHERE NOT coalesce(fit, false)) AS left_out FROM r GROUP BY 1)""")
def lane_shares(m: DataFrame, d: DataFrame) -> DataFrame:
    """Tokens and share of each lane; counts that are null, not positive or above the bytes of their record are left out, and counted."""
    sizes = d.where("text is not null").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes"))
    rows = m.select(F.coalesce(F.lower(F.trim("capability_lane")), F.lit("none")).alias("lane"), "token_count", F.col("doc_ids")[0].alias("doc_id")).join(sizes, "doc_id", "left")
    fit = F.coalesce((F.col("token_count") > 0) & (F.col("bytes").isNull() | (F.col("token_count") <= F.col("bytes"))), F.lit(False))
    per = rows.groupBy("lane").agg(F.coalesce(F.sum(F.when(fit, F.col("token_count"))), F.lit(0)).alias("tokens"), F.count_if(~fit).alias("left_out"))
    total = per.agg(F.sum("tokens").alias("total"))
    return per.join(F.broadcast(total)).select("lane", "tokens", F.floor(F.col("tokens") * 10000 / F.col("total")).alias("per_10k"), "left_out")


@query("s_set_operations", "manifest", "ledger", sql="""WITH a AS (SELECT DISTINCT shard_id FROM manifest), b AS (SELECT DISTINCT unnest(shard_ids) AS shard_id FROM ledger)
SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS in_either, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS in_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS unused, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS unknown""")
def set_operations(m: DataFrame, e: DataFrame) -> DataFrame:
    a = m.select("shard_id").withColumn("a", F.lit(1))
    b = e.select(F.explode("shard_ids").alias("shard_id")).withColumn("b", F.lit(1))
    per = a.unionByName(b, allowMissingColumns=True).groupBy("shard_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    known, used = F.col("a").isNotNull(), F.col("b").isNotNull()
    return per.agg(F.count(F.lit(1)).alias("in_either"), F.count_if(known & used).alias("in_both"), F.count_if(known & ~used).alias("unused"), F.count_if(used & ~known).alias("unknown"))
