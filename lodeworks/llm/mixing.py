"""Drawing shards so that each source contributes its share of a stage's tokens.

Each shard gets a hash-random key per stage. Within a source the keys are cut into ranges,
token counts are summed per range, the sums are added up over the ranges, and only then is
order taken inside a range: together an exact prefix sum over any number of shards. Whole
epochs of a source are drawn while they fit its budget and the cap on repeats; the last
epoch is cut where the prefix sum reaches what is left, at the nearest shard.

Of a shard written more than once its latest row counts (ties: the larger token count,
then lane). Rows without a shard or lane, and token counts that are null or not positive,
are not drawn; nor are counts above the bytes of the shard's own records, since a token
takes a byte at least. A shard of which no record is known is taken at its word. What is
left out is reported per lane. Lanes are compared trimmed and in lower case. A lane of the
plan without shards is reported with nothing drawn; an empty table draws nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.runtime import Stage

#: Shards of a range of keys, about: more shards are cut into more ranges.
RANGE = 20_000
#: Hexadecimal digits of a key that name its range, at most.
RANGE_DIGITS = 5


def _lane(column: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^\s+|\s+$", ""))


def counted(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """``shard_id``, ``lane``, ``token_count`` of each shard's latest row, and ``fit``: whether it can be drawn.

    ``texts`` has the records, by ``doc_id``, whose bytes bound a shard's tokens; of a record
    delivered more than once the longest text counts.
    """
    latest = manifest.where(F.col("shard_id").isNotNull()).groupBy("shard_id").agg(
        F.max(F.struct("generated_at", "token_count", _lane("capability_lane").alias("lane"), "doc_ids")).alias("row")
    )
    rows = latest.select("shard_id", F.col("row.lane").alias("lane"), F.col("row.token_count").alias("token_count"), F.col("row.doc_ids").alias("doc_ids"))
    sizes = texts.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.octet_length("text").cast("long").alias("bytes")).groupBy("doc_id").agg(F.max("bytes").alias("bytes"))
    held = rows.select("shard_id", F.explode("doc_ids").alias("doc_id")).join(sizes, "doc_id").groupBy("shard_id").agg(F.sum("bytes").alias("bytes"))
    fit = (F.length("lane") > 0) & (F.col("token_count") > 0) & (F.col("bytes").isNull() | (F.col("token_count") <= F.col("bytes")))
    return rows.drop("doc_ids").join(held, "shard_id", "left").select("shard_id", "lane", "token_count", F.coalesce(fit, F.lit(False)).alias("fit"))


def supply(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """``shard_id``, ``lane``, ``token_count`` of each shard's latest row that can be drawn."""
    return counted(manifest, texts).where("fit").drop("fit")


def targets(feasibility: DataFrame, mixture: DataFrame) -> DataFrame:
    """Stage, lane, ``need``, ``planned_supply``, ``share`` of the stage's need, ``budget``, ``max_repeats``.

    Where no need was recorded for a planned lane, its planned share of the needs stands in.
    """
    plan = mixture.groupBy("stage", _lane("lane").alias("lane")).agg(
        F.max("share_pct").alias("share_pct"), F.max("max_repeats").alias("max_repeats"), F.max("token_budget").alias("token_budget")
    )
    asked = feasibility.groupBy("stage", _lane("lane").alias("lane")).agg(F.max("need").alias("need"), F.max("supply").alias("planned_supply"))
    stage = Window.partitionBy("stage")
    joined = plan.join(asked, ["stage", "lane"], "left")
    known = F.sum("need").over(stage) / F.sum(F.when(F.col("need").isNotNull(), F.col("share_pct"))).over(stage)
    weighed = joined.withColumn("weight", F.coalesce("need", F.col("share_pct") * known, F.col("share_pct")))
    share = F.col("weight") / F.sum("weight").over(stage)
    return weighed.select("stage", "lane", "need", "planned_supply", share.alias("share"), F.floor(F.col("token_budget") * share).alias("budget"), "max_repeats")


def _drawn(shards: DataFrame, totals: DataFrame, aims: DataFrame, range_: int) -> DataFrame:
    plan = aims.join(totals, "lane")
    epochs = F.least(F.col("max_repeats").cast("long"), F.floor(F.col("budget") / F.col("supply")))
    # One more hexadecimal digit as often as it takes for a range to hold about range_ shards.
    digits = F.least(F.greatest(F.ceil(F.log(F.col("n") / F.lit(range_)) / F.log(F.lit(16.0))), F.lit(0)), F.lit(RANGE_DIGITS)).cast("int")
    plan = plan.withColumns({"epochs": epochs, "digits": digits}).select(
        "stage", "lane", "epochs", "digits", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("supply")).otherwise(0).alias("rest")
    )
    mixed = F.md5(F.concat_ws("|", "stage", "shard_id"))
    # A row per planned stage and lane: the plan is a table of a few rows whatever the corpus.
    keyed = shards.join(F.broadcast(plan), "lane").withColumns({"key": F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long"), "range": F.substring(mixed, F.lit(1), F.col("digits"))})
    ranges = keyed.groupBy("stage", "lane", "range").agg(F.sum("token_count").alias("tokens"))
    before = Window.partitionBy("stage", "lane").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("stage", "lane", "range", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("stage", "lane", "range").orderBy("key", "shard_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(starts, ["stage", "lane", "range"]).withColumn("prefix", F.col("start") + F.coalesce(F.sum("token_count").over(inside), F.lit(0)))
    cut = (2 * F.col("prefix") + F.col("token_count") <= 2 * F.col("rest")).cast("long")
    return placed.withColumn("uses", F.col("epochs") + cut).where("uses > 0").select("stage", "lane", "shard_id", "token_count", "uses")


def _per_lane(shards: DataFrame) -> DataFrame:
    return shards.groupBy("lane").agg(F.sum("token_count").alias("supply"), F.count(F.lit(1)).alias("n"))


def drawn(manifest: DataFrame, feasibility: DataFrame, mixture: DataFrame, texts: DataFrame, range_: int = RANGE) -> DataFrame:
    """``stage``, ``lane``, ``shard_id``, ``token_count``, ``uses`` of every shard that is drawn."""
    shards = Stage(manifest.sparkSession, "mixing").keep(supply(manifest, texts), "shards")
    return _drawn(shards, _per_lane(shards), targets(feasibility, mixture), range_)


def report(manifest: DataFrame, feasibility: DataFrame, mixture: DataFrame, texts: DataFrame, range_: int = RANGE) -> DataFrame:
    """Per stage and lane: what was aimed at, what was drawn, what is missing, and what of the lane was left out."""
    rows = Stage(manifest.sparkSession, "mixing").keep(counted(manifest, texts), "counted")
    shards = rows.where("fit").drop("fit")
    totals = _per_lane(shards)
    got = _drawn(shards, totals, targets(feasibility, mixture), range_).groupBy("stage", "lane").agg(
        F.sum(F.col("token_count") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("shards"), F.max("uses").alias("most_uses")
    )
    out = rows.where("not fit").groupBy("lane").agg(F.count(F.lit(1)).alias("left_out"), F.coalesce(F.sum(F.greatest("token_count", F.lit(0))), F.lit(0)).alias("left_out_tokens"))
    per = totals.select("lane", F.col("supply").alias("supply_now"))
    joined = targets(feasibility, mixture).join(got, ["stage", "lane"], "left").join(per, "lane", "left").join(out, "lane", "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "shards", "most_uses", "supply_now", "left_out", "left_out_tokens")})
    stage = Window.partitionBy("stage")
    return filled.select(
        "stage", "lane", "need", "planned_supply", "supply_now", "budget", "tokens", "shards", "most_uses",
        F.col("share").alias("target_share"),
        F.when(F.sum("tokens").over(stage) > 0, F.col("tokens") / F.sum("tokens").over(stage)).otherwise(0.0).alias("actual_share"),
        F.greatest(F.col("budget") - F.col("tokens"), F.lit(0)).alias("missing"),
        F.greatest(F.col("need") - F.col("tokens"), F.lit(0.0)).alias("missing_of_need"),
        "left_out", "left_out_tokens",
    )


_SUPPLY = f"""
latest AS (
  SELECT shard_id, lower(regexp_replace(capability_lane, '^\\s+|\\s+$', '', 'g')) AS lane, token_count, doc_ids,
         row_number() OVER (PARTITION BY shard_id ORDER BY generated_at DESC NULLS LAST, token_count DESC NULLS LAST, lower(capability_lane) DESC NULLS LAST) AS n
  FROM manifest WHERE shard_id IS NOT NULL),
sizes AS (SELECT doc_id, max(octet_length(encode(text))) AS bytes FROM run_pipeline WHERE text IS NOT NULL GROUP BY doc_id),
held AS (SELECT shard_id, sum(bytes) AS bytes FROM (SELECT shard_id, unnest(doc_ids) AS doc_id FROM latest WHERE n = 1) JOIN sizes USING (doc_id) GROUP BY shard_id),
counted AS (SELECT shard_id, lane, token_count, coalesce(length(lane) > 0 AND token_count > 0 AND (bytes IS NULL OR token_count <= bytes), false) AS fit FROM latest LEFT JOIN held USING (shard_id) WHERE n = 1),
shards AS (SELECT shard_id, lane, token_count FROM counted WHERE fit),
outside AS (SELECT lane, count(*) AS left_out, coalesce(sum(greatest(token_count, 0)), 0)::BIGINT AS left_out_tokens FROM counted WHERE NOT fit GROUP BY lane),
totals AS (SELECT lane, sum(token_count)::BIGINT AS supply FROM shards GROUP BY lane),
plan AS (SELECT stage, lower(trim(lane)) AS lane, max(share_pct) AS share_pct, max(max_repeats) AS max_repeats, max(token_budget) AS token_budget FROM mixture GROUP BY 1, 2),
asked AS (SELECT stage, lower(trim(lane)) AS lane, max(need) AS need, max(supply) AS planned_supply FROM feasibility GROUP BY 1, 2),
weighed AS (
  SELECT p.*, a.need, a.planned_supply,
         coalesce(a.need, p.share_pct * sum(a.need) OVER s / sum(CASE WHEN a.need IS NOT NULL THEN p.share_pct END) OVER s, p.share_pct) AS weight
  FROM plan p LEFT JOIN asked a USING (stage, lane) WINDOW s AS (PARTITION BY p.stage)),
targets AS (SELECT *, weight / sum(weight) OVER (PARTITION BY stage) AS share, floor(token_budget * (weight / sum(weight) OVER (PARTITION BY stage)))::BIGINT AS budget FROM weighed),
goals AS (SELECT *, least(max_repeats, floor(budget / supply))::BIGINT AS epochs FROM targets JOIN totals USING (lane)),
keyed AS (
  SELECT g.stage, lane, shard_id, token_count, epochs, CASE WHEN epochs < max_repeats THEN budget - epochs * supply ELSE 0 END AS rest,
         ('0x' || substr(md5(g.stage || '|' || shard_id), 1, 15))::BIGINT AS key
  FROM shards JOIN goals g USING (lane)),
placed AS (SELECT *, coalesce(sum(token_count) OVER (PARTITION BY stage, lane ORDER BY key, shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix FROM keyed),
drawn AS (SELECT stage, lane, shard_id, token_count, epochs + (CASE WHEN 2 * prefix + token_count <= 2 * rest THEN 1 ELSE 0 END) AS uses FROM placed)"""

DRAWN_SQL = f"WITH {_SUPPLY} SELECT stage, lane, shard_id, token_count, uses FROM drawn WHERE uses > 0"

REPORT_SQL = f"""WITH {_SUPPLY},
got AS (SELECT stage, lane, sum(token_count * uses)::BIGINT AS tokens, count(*) AS shards, max(uses) AS most_uses FROM drawn WHERE uses > 0 GROUP BY 1, 2),
filled AS (
  SELECT t.stage, lane, t.need, t.planned_supply, coalesce(totals.supply, 0) AS supply_now, t.budget, coalesce(tokens, 0) AS tokens,
         coalesce(shards, 0) AS shards, coalesce(most_uses, 0) AS most_uses, t.share AS target_share, coalesce(left_out, 0) AS left_out, coalesce(left_out_tokens, 0) AS left_out_tokens
  FROM targets t LEFT JOIN got USING (stage, lane) LEFT JOIN totals USING (lane) LEFT JOIN outside USING (lane))
SELECT *, CASE WHEN sum(tokens) OVER s > 0 THEN tokens / sum(tokens) OVER s ELSE 0.0 END AS actual_share,
       greatest(budget - tokens, 0) AS missing, greatest(need - tokens, 0.0) AS missing_of_need
FROM filled WINDOW s AS (PARTITION BY stage)"""
