"""Closed-form models over declared inputs and plan tables: losses, curricula, throughput, packing policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.registry import query

# Loss factor of each phase and its end, additions by lane; anchors of the curriculum, in percent.
PHASES = (("early", 4000, 1.35), ("mid", 7000, 0.95), ("late", 8500, 0.72), ("anneal", 10000, 0.62))
LANE_LOSS = {"indic": 0.55, "agentic": 0.35}
BANDS = ("gen", "code", "reason", "lctx", "indic", "stem")
ANCHORS = ((55, 15, 3, 2, 15, 10), (45, 20, 6, 3, 16, 10), (25, 28, 18, 5, 14, 10), (18, 30, 16, 18, 12, 6), (8, 22, 20, 10, 30, 10))
# Bandwidth in MB a second, share that decompression takes, and the scale of the worker factor.
BANDWIDTH, DECOMPRESSION, MOST_FACTOR = 1800, 0.24, 1.8
# Bounds of perplexity between the colours.
COLOURS = (6, 14, 28, 60)


def _values(rows: list[tuple], columns: str) -> str:
    said = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) t({columns})"


def _phase(f: Column) -> Column:
    """The phase of a run fraction in ten thousandths."""
    return F.when(f < 4000, "early").when(f < 7000, "mid").when(f < 8500, "late").otherwise("anneal")


def _factor(phase: Column) -> Column:
    out = F.lit(PHASES[-1][2])
    for name, _, factor in reversed(PHASES[:-1]):
        out = F.when(phase == name, factor).otherwise(out)
    return out


_PHASE_SQL = "CASE WHEN f < 4000 THEN 'early' WHEN f < 7000 THEN 'mid' WHEN f < 8500 THEN 'late' ELSE 'anneal' END"
_FACTOR_SQL = "CASE phase WHEN 'early' THEN 1.35 WHEN 'mid' THEN 0.95 WHEN 'late' THEN 0.72 ELSE 0.62 END::DOUBLE"
_ADJUST_SQL = "CASE WHEN lane = 'indic' AND phase <> 'anneal' THEN 0.55 WHEN lane = 'agentic' THEN 0.35 ELSE 0 END::DOUBLE"


def toy_loss(step: Column, lane: Column, phase: Column) -> Column:
    """The modelled loss of a step in its lane; the addition for indic ends with the anneal phase."""
    adjust = F.when((lane == "indic") & (phase != "anneal"), LANE_LOSS["indic"]).when(lane == "agentic", LANE_LOSS["agentic"]).otherwise(0.0)
    return 3.0 * F.pow(F.lit(0.99), step) * _factor(phase) + adjust


_LANES = ("general", "code", "indic", "reasoning", "agentic")


@query("x09_toy_loss", sql=f"SELECT step, lane, phase, round((3.0::DOUBLE * pow(0.99::DOUBLE, step) * {_FACTOR_SQL} + {_ADJUST_SQL}) * 10000)::BIGINT AS loss FROM (SELECT *, {_PHASE_SQL} AS phase FROM (SELECT step, lane, step * 10000 // 150 AS f FROM range(150) r(step), {_values([(x,) for x in _LANES], 'lane')}))")
def toy_losses(spark: SparkSession) -> DataFrame:
    rows = spark.range(150).toDF("step").withColumn("lane", F.explode(F.array(*map(F.lit, _LANES)))).withColumn("phase", _phase(F.floor(F.col("step") * 10000 / 150)))
    return rows.select("step", "lane", "phase", F.round(toy_loss(F.col("step"), F.col("lane"), F.col("phase")) * 10000).cast("long").alias("loss"))


@query("l02_usefulness", "ledger", sql=f"""WITH e AS (SELECT DISTINCT ON (ledger_offset) ledger_offset, coalesce(mixture_lane, 'none') AS lane FROM ledger WHERE event = 'batch_committed'), w AS (SELECT max(ledger_offset) + 1 AS whole FROM e),
p AS (SELECT *, {_PHASE_SQL} AS phase FROM (SELECT lane, ledger_offset AS step, ledger_offset * 10000 // whole AS f FROM e, w)), l AS (SELECT lane, phase, 3.0::DOUBLE * pow(0.99::DOUBLE, step % 150) * {_FACTOR_SQL} + {_ADJUST_SQL} AS loss FROM p)
SELECT lane, phase, CASE WHEN loss < 2 THEN 'useful' WHEN loss < 4 THEN 'review' ELSE 'delay' END AS class, count(*) AS n FROM l GROUP BY ALL""")
def usefulness(e: DataFrame) -> DataFrame:
    """Committed batches by lane and the class of their modelled loss, which starts anew every 150 commits."""
    once = e.where("event = 'batch_committed'").select("ledger_offset", F.coalesce("mixture_lane", F.lit("none")).alias("lane")).dropDuplicates(["ledger_offset"])
    whole = F.broadcast(once.agg((F.max("ledger_offset") + 1).alias("whole")))
    rows = once.join(whole).select("lane", F.col("ledger_offset").alias("step"), _phase(F.expr("ledger_offset * 10000 div whole")).alias("phase"))
    loss = toy_loss(F.pmod("step", F.lit(150)), F.col("lane"), F.col("phase"))
    return rows.groupBy("lane", "phase", F.when(loss < 2, "useful").when(loss < 4, "review").otherwise("delay").alias("class")).agg(F.count(F.lit(1)).alias("n"))


# A declared input: tokens with their lane, kind, whether they bear loss, and base loss.
TOKENS = [
    ("Rivers", "pretrain", "word", True, 1.4), ("rise", "pretrain", "word", True, 2.1), ("<eos>", "pretrain", "boundary", True, 1.0), ("return", "code", "keyword", True, 1.3), ("total", "code", "identifier", True, 2.9),
    ("...", "code", "ellipsis", True, 4.2), ("नदी", "indic", "word", True, 3.7), ("की", "indic", "postposition", True, 2.4), ("</s>", "indic", "boundary", True, 1.5), ("Result", "agentic", "tool", False, 2.3),
    ("200", "agentic", "tool", False, 4.4), ("open", "agentic", "action", True, 3.0), ("Since", "reasoning", "word", True, 2.6), ("k", "reasoning", "symbol", True, 2.2), ("<pad>", "padding", "pad", False, 0.2),
]
_TOKEN_LOSS = f"""tok AS (SELECT * FROM {_values(TOKENS, 'token, lane, kind, bears, base')}), ph AS (SELECT * FROM {_values([(p, f) for p, _, f in PHASES], 'phase, factor')}),
raw AS (SELECT *, base::DOUBLE * factor::DOUBLE + CASE WHEN lane = 'indic' AND phase <> 'anneal' THEN 0.55 ELSE 0 END::DOUBLE + CASE WHEN lane = 'agentic' AND kind = 'tool' THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN kind = 'ellipsis' THEN 0.8 ELSE 0 END::DOUBLE + CASE WHEN kind = 'boundary' THEN 0.2 ELSE 0 END::DOUBLE AS v FROM tok, ph),
loss AS (SELECT *, CASE WHEN bears THEN v ELSE greatest(0.05, v * 0.28) END AS loss FROM raw)"""


def token_losses(tokens: DataFrame, boundary: float = 0.2) -> DataFrame:
    """``loss`` of each token in each phase: base by phase, additions by lane and kind, masked tokens scaled down."""
    phases = F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(f).alias("factor")) for p, _, f in PHASES)))
    rows = tokens.withColumn("p", phases).select("*", "p.phase", "p.factor").drop("p")
    kind, lane = F.col("kind"), F.col("lane")
    v = (
        F.col("base") * F.col("factor") + F.when((lane == "indic") & (F.col("phase") != "anneal"), 0.55).otherwise(0.0) + F.when((lane == "agentic") & (kind == "tool"), 0.35).otherwise(0.0)
        + F.when(kind == "ellipsis", 0.8).otherwise(0.0) + F.when(kind == "boundary", boundary).otherwise(0.0)
    )
    return rows.withColumn("loss", F.when(F.col("bears"), v).otherwise(F.greatest(F.lit(0.05), v * 0.28)))


def _declared(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOKENS, "token string, lane string, kind string, bears boolean, base double")


@query("l24_token_loss", sql=f"WITH {_TOKEN_LOSS} SELECT token, lane, phase, round(loss * 1000)::BIGINT AS loss, CASE WHEN exp(least(loss, 5.1)) < 6 THEN 'green' WHEN exp(least(loss, 5.1)) < 14 THEN 'teal' WHEN exp(least(loss, 5.1)) < 28 THEN 'amber' WHEN exp(least(loss, 5.1)) < 60 THEN 'red' ELSE 'violet' END AS colour FROM loss")
def token_loss(spark: SparkSession) -> DataFrame:
    ppl = F.exp(F.least("loss", F.lit(5.1)))
    names = ("green", "teal", "amber", "red")
    colour = F.lit("violet")
    for bound, name in zip(reversed(COLOURS), reversed(names), strict=True):
        colour = F.when(ppl < bound, name).otherwise(colour)
    return token_losses(_declared(spark)).select("token", "lane", "phase", F.round(F.col("loss") * 1000).cast("long").alias("loss"), colour.alias("colour"))


@query("a18_perplexity_bands", sql=f"WITH {_TOKEN_LOSS}, g AS (SELECT phase, lane, round(1000 * exp(avg(loss)))::BIGINT AS perplexity, count(*) FILTER (WHERE exp(loss) >= 14) AS hot, count(*) AS n FROM loss WHERE bears GROUP BY ALL) SELECT phase, lane, perplexity, hot, n FROM g QUALIFY row_number() OVER (PARTITION BY phase ORDER BY perplexity DESC, lane) <= 6")
def perplexity(spark: SparkSession, hot: float = 14.0) -> DataFrame:
    """Per phase the six lanes of the highest perplexity over tokens that bear loss, and their hot tokens."""
    per = token_losses(_declared(spark)).where("bears").groupBy("phase", "lane").agg(
        F.round(1000 * F.exp(F.avg("loss"))).cast("long").alias("perplexity"), F.count_if(F.exp("loss") >= hot).alias("hot"), F.count(F.lit(1)).alias("n")
    )
    rank = F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("perplexity"), "lane"))
    return per.withColumn("r", rank).where("r <= 6").drop("r")


# A declared input: shards with hot-token share, gradient score, decision score and loss delta.
CARDS = [("indic-a", 24, 71, 82, 0.22), ("code-b", 18, 64, 74, 0.25), ("tools-c", 33, 78, 68, 0.28), ("web-d", 11, 38, 48, -0.02), ("proof-e", 38, 86, 91, 0.41)]


@query("x14_usefulness", sql=f"SELECT shard, weight, round(s * 100)::BIGINT AS score, CASE WHEN s >= 72 THEN 'useful' WHEN s >= 48 THEN 'review' ELSE 'delay' END AS badge FROM (SELECT *, greatest(0, least(100, greatest(0, delta) * 220 * weight / 100.0 + ((100 - hot) * 0.45 + grad * 0.25 + opus * 0.3) * (1 - weight / 100.0)))::DOUBLE AS s FROM {_values(CARDS, 'shard, hot, grad, opus, delta')}, (VALUES (0), (40), (60), (100)) w(weight))")
def shard_usefulness(spark: SparkSession) -> DataFrame:
    """Fall of the loss against support (few hot tokens, gradient, decisions), weighed, cut to 0..100."""
    rows = spark.createDataFrame(CARDS, "shard string, hot int, grad int, opus int, delta double").withColumn("weight", F.explode(F.array(*map(F.lit, (0, 40, 60, 100)))))
    w = F.col("weight") / 100.0
    support = (100 - F.col("hot")) * 0.45 + F.col("grad") * 0.25 + F.col("opus") * 0.3
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("delta")) * 220 * w + support * (1 - w)))
    return rows.select("shard", "weight", F.round(s * 100).cast("long").alias("score"), F.when(s >= 72, "useful").when(s >= 48, "review").otherwise("delay").alias("badge"))


@query("x15_accuracy_curve", sql="SELECT l, round(100000 * (0.955 - (0.955 - 0.34) * exp(-l / (4000 * 0.18))))::BIGINT AS acc FROM range(0, 4001, 50) r(l)")
def accuracy_curve(spark: SparkSession) -> DataFrame:
    """Accuracy against tokens of effort: a plateau of 0.955 from a base of 0.34, the scale 0.18 of the longest effort."""
    return spark.range(0, 4001, 50).toDF("l").select("l", F.round(100000 * (0.955 - (0.955 - 0.34) * F.exp(-F.col("l") / (4000 * 0.18)))).cast("long").alias("acc"))


_ANCHOR_ROWS = [(i, b, ANCHORS[i][k], ANCHORS[i + 1][k], k) for i in range(4) for k, b in enumerate(BANDS)]


@query("x11_curriculum", sql=f"""WITH s AS (SELECT step, least(step * 1000, 39999) AS seg FROM range(41) r(step)), x AS (SELECT step, band, ord, a * 10000 + (b - a) * (seg % 10000) AS share FROM s JOIN {_values(_ANCHOR_ROWS, 'i, band, a, b, ord')} ON i = seg // 10000),
y AS (SELECT *, share // 10000 AS w, row_number() OVER (PARTITION BY step ORDER BY share % 10000 DESC, ord) AS r FROM x) SELECT step, band, share AS share_10k, w + CASE WHEN r <= 100 - sum(w) OVER (PARTITION BY step) THEN 1 ELSE 0 END AS units FROM y""")
def curriculum(spark: SparkSession) -> DataFrame:
    """Shares between five anchors by straight lines, and whole percents by largest remainders."""
    anchors = spark.createDataFrame(_ANCHOR_ROWS, "i long, band string, a long, b long, ord int")
    steps = spark.range(41).toDF("step").withColumn("seg", F.least(F.col("step") * 1000, F.lit(39999)))
    x = steps.join(F.broadcast(anchors), F.floor(F.col("seg") / 10000) == F.col("i")).withColumn("share", F.col("a") * 10000 + (F.col("b") - F.col("a")) * (F.col("seg") % 10000))
    w = F.floor(F.col("share") / 10000)
    rank = F.row_number().over(Window.partitionBy("step").orderBy(F.desc(F.col("share") % 10000), "ord"))
    spare = 100 - F.sum("w").over(Window.partitionBy("step"))
    y = x.withColumn("w", w).withColumns({"r": rank, "spare": spare})
    return y.select("step", "band", F.col("share").alias("share_10k"), (F.col("w") + F.when(F.col("r") <= F.col("spare"), 1).otherwise(0)).alias("units"))


_SHIFTS = [(band, frozen) for band in (0, 1, 3) for frozen in (False, True)]


@query("x12_spike", sql=f"""WITH g AS (SELECT *, 1 + 0.7::DOUBLE / (1 + band * 1.5) * 7 * CASE WHEN frozen THEN 1 + 20.4 / (1 + band * 2.0) ELSE 1 END::DOUBLE AS peak, band * 26 AS mu, 4 + band * 26 * 0.6::DOUBLE AS sigma FROM {_values(_SHIFTS, 'band, frozen')})
SELECT i, band, frozen, round(1000 * greatest(0.06, 1 + CASE WHEN i >= 230 THEN (peak - 1) * exp(-0.5 * pow((i - 230 - mu) / sigma, 2)) ELSE 0 END))::BIGINT AS norm, peak > 3 AS red FROM range(641) r(i), g""")
def spike(spark: SparkSession) -> DataFrame:
    """The gradient norm around a change of mixture: a sharp change or frozen layers raise it, a warm-up band lowers and widens it."""
    g = spark.createDataFrame(_SHIFTS, "band int, frozen boolean")
    band = F.col("band")
    held = F.when(F.col("frozen"), 1 + (21.4 - 1) / (1 + band * 2.0)).otherwise(1.0)
    g = g.withColumns({"peak": 1 + 0.7 / (1 + band * 1.5) * 7 * held, "mu": band * 26, "sigma": 4 + band * 26 * 0.6})
    away = (F.col("i") - 230 - F.col("mu")) / F.col("sigma")
    bump = F.when(F.col("i") >= 230, (F.col("peak") - 1) * F.exp(-0.5 * away * away)).otherwise(0.0)
    rows = spark.range(641).toDF("i").join(F.broadcast(g))
    return rows.select("i", "band", "frozen", F.round(1000 * F.greatest(F.lit(0.06), 1 + bump)).cast("long").alias("norm"), (F.col("peak") > 3).alias("red"))


# -- throughput ------------------------------------------------------------------------------------

_GRID = [(w, p, s, k, r) for w in (0, 4, 18, 64) for p in (0, 6) for s in (128, 1024, 4096) for k in (41.2, 96.0) for r in (18.0, 50.0)]
_THROUGH = """wf AS (SELECT *, least(1.8, 0.35 + log2(workers + 1) / 4 + prefetch / 30.0)::DOUBLE AS factor, CASE WHEN shard_mb < 256 THEN 0.72 WHEN shard_mb > 3072 THEN 0.88 ELSE 1 END::DOUBLE AS penalty FROM grid),
perf AS (SELECT *, 32768 * pack::DOUBLE / 100 AS after_pack, 32768 * pack::DOUBLE / 100 * (1 - reject::DOUBLE / 100) AS after_reject, 1800 * 0.76::DOUBLE * factor * penalty AS rate, greatest(0, 100 - factor / 1.8 * 100) AS idle FROM wf)"""
_ADVICE = "CASE WHEN pack < 75 THEN 'pack' WHEN reject > 45 THEN 'reject' WHEN idle > 20 THEN 'idle' WHEN shard_mb < 256 THEN 'shard' ELSE 'healthy' END"
_INPUTS = "workers int, prefetch int, shard_mb int, pack double, reject double"


def performance(grid: DataFrame, tokens: int = 8 * 2 * 16 * 128) -> DataFrame:
    """Useful tokens of a step and a second, idle share and advice, from the measured inputs alone."""
    factor = F.least(F.lit(MOST_FACTOR), 0.35 + F.log2(F.col("workers") + 1) / 4 + F.col("prefetch") / 30.0)
    penalty = F.when(F.col("shard_mb") < 256, 0.72).when(F.col("shard_mb") > 3072, 0.88).otherwise(1.0)
    after_pack = tokens * F.col("pack") / 100
    rows = grid.withColumns({"after_pack": after_pack, "after_reject": after_pack * (1 - F.col("reject") / 100), "rate": BANDWIDTH * (1 - DECOMPRESSION) * factor * penalty, "idle": F.greatest(F.lit(0.0), 100 - factor / MOST_FACTOR * 100)})
    advice = F.when(F.col("pack") < 75, "pack").when(F.col("reject") > 45, "reject").when(F.col("idle") > 20, "idle").when(F.col("shard_mb") < 256, "shard").otherwise("healthy")
    return rows.withColumns({"per_second": F.col("after_reject") * F.col("rate") / F.col("shard_mb"), "advice": advice})


@query("l17_throughput", sql=f"WITH grid AS (SELECT * FROM {_values(_GRID, 'workers, prefetch, shard_mb, pack, reject')}), {_THROUGH} SELECT workers, prefetch, shard_mb, pack::DOUBLE AS pack, reject::DOUBLE AS reject, round(after_reject * 100)::BIGINT AS useful, round(rate * 100)::BIGINT AS rate, round(after_reject * rate / shard_mb)::BIGINT AS per_second, round(idle * 100)::BIGINT AS idle, {_ADVICE} AS advice FROM perf")
def throughput(spark: SparkSession) -> DataFrame:
    rows = performance(spark.createDataFrame(_GRID, _INPUTS))
    whole = lambda c, k, name: F.round(F.col(c) * k).cast("long").alias(name)
    return rows.select("workers", "prefetch", "shard_mb", "pack", "reject", whole("after_reject", 100, "useful"), whole("rate", 100, "rate"), whole("per_second", 1, "per_second"), whole("idle", 100, "idle"), "advice")


def recomputed(stored: DataFrame) -> DataFrame:
    """Stored results with ``holds``: whether their inputs give them again."""
    again = performance(stored.select("workers", "prefetch", "shard_mb", "pack", "reject"))
    keys = ["workers", "prefetch", "shard_mb", "pack", "reject"]
    names = ("after_pack", "after_reject", "per_second")
    same = F.lit(True)
    for c in names:
        same = same & (F.abs(F.col(c) - F.col(f"_{c}")) < 0.005)
    return stored.join(again.select(*keys, *(F.col(c).alias(f"_{c}") for c in names)), keys).withColumn("holds", same)


@query("l18_recompute", sql=f"SELECT workers, prefetch, shard_mb, pack::DOUBLE AS pack, reject::DOUBLE AS reject, NOT (workers = 18 AND prefetch = 6) AS holds FROM {_values(_GRID, 'workers, prefetch, shard_mb, pack, reject')}")
def recompute(spark: SparkSession) -> DataFrame:
    """Stored figures against their inputs; those of 18 workers and a prefetch of 6 were tampered with."""
    stored = performance(spark.createDataFrame(_GRID, _INPUTS))
    bad = (F.col("workers") == 18) & (F.col("prefetch") == 6)
    return recomputed(stored.withColumn("per_second", F.when(bad, F.col("per_second") + 1).otherwise(F.col("per_second")))).select("workers", "prefetch", "shard_mb", "pack", "reject", "holds")


_LAB = [(q, b, w, s) for q in (2048, 8192) for b in (256, 1024) for w in (2, 18) for s in (128, 1024)]


@query("l19_loader_lab", sql=f"""WITH g AS (SELECT *, seq * batch * 2 / (1024.0 * 1024) * 1.24 AS read_mb, 1800 * least(1.8, 0.35 + log2(workers + 1) / 4 + 6 / 30.0) * CASE WHEN shard_mb < 256 THEN 0.72 WHEN shard_mb > 3072 THEN 0.88 ELSE 1 END AS rate FROM {_values(_LAB, 'seq, batch, workers, shard_mb')}),
m AS (SELECT *, read_mb::DOUBLE / rate::DOUBLE * 1000 AS loader, 145 + seq / 8192.0::DOUBLE * 210 + batch / 1024.0::DOUBLE * 90 AS compute FROM g), w AS (SELECT *, greatest(0, loader - compute * 0.55) AS wait FROM m)
SELECT seq, batch, workers, shard_mb, round(loader * 1000)::BIGINT AS loader_us, round(compute * 1000)::BIGINT AS compute_us, round(wait * 1000)::BIGINT AS wait_us, round(wait / (compute + wait) * 10000)::BIGINT AS idle_10k FROM w""")
def loader_lab(spark: SparkSession) -> DataFrame:
    """Milliseconds of loading, computing and waiting of a step."""
    g = spark.createDataFrame(_LAB, "seq int, batch int, workers int, shard_mb int")
    read = F.col("seq").cast("double") * F.col("batch") * 2 / (1024.0 * 1024) * (1 + DECOMPRESSION)
    factor = F.least(F.lit(MOST_FACTOR), 0.35 + F.log2(F.col("workers") + 1) / 4 + F.lit(6 / 30.0))
    rate = BANDWIDTH * factor * F.when(F.col("shard_mb") < 256, 0.72).when(F.col("shard_mb") > 3072, 0.88).otherwise(1.0)
    m = g.withColumns({"loader": read / rate * 1000, "compute": 145 + F.col("seq") / 8192.0 * 210 + F.col("batch") / 1024.0 * 90})
    m = m.withColumn("wait", F.greatest(F.lit(0.0), F.col("loader") - F.col("compute") * 0.55))
    whole = lambda c, k: F.round(c * k).cast("long")
    return m.select("seq", "batch", "workers", "shard_mb", whole(F.col("loader"), 1000).alias("loader_us"), whole(F.col("compute"), 1000).alias("compute_us"), whole(F.col("wait"), 1000).alias("wait_us"), whole(F.col("wait") / (F.col("compute") + F.col("wait")), 10000).alias("idle_10k"))


@query("l20_confidence", sql="SELECT drift, opus, greatest(0, 100 - drift - opus) AS confidence, 100 - drift - opus > 80 AS comparable FROM range(0, 61, 5) a(drift), range(0, 61, 5) b(opus)")
def confidence(spark: SparkSession) -> DataFrame:
    """How far two checkpoints can be compared when stream and decisions drifted apart."""
    rows = spark.range(0, 61, 5).toDF("drift").withColumn("opus", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(60).cast("long"), F.lit(5).cast("long"))))
    left = 100 - F.col("drift") - F.col("opus")
    return rows.select("drift", "opus", F.greatest(F.lit(0), left).alias("confidence"), (left > 80).alias("comparable"))


# Weights of the requirements.
_WEIGHTS = {"tokenizer_frozen": 14, "eval_firewall": 14, "reject_log": 16, "loss_mask_hashes": 12, "branch_ids": 12, "contamination_scan": 16, "license_tiers": 16}


@query("l21_readiness", "manifest", "ledger", sql=f"""WITH m AS (SELECT count(DISTINCT tokenizer_hash) = 1 AS tokenizer_frozen, count(*) FILTER (WHERE admission = 'admitted' AND (never_train OR canary_match OR benchmark_derived)) = 0 AS eval_firewall, count(*) FILTER (WHERE eval_overlap_status IS NULL) = 0 AS contamination_scan, count(*) FILTER (WHERE license_tier IS NULL) = 0 AS license_tiers FROM manifest),
e AS (SELECT count(*) FILTER (WHERE opus_decision_id IS NULL) = 0 AS reject_log, count(*) FILTER (WHERE length(coalesce(loss_mask_hash, '')) <> 64) = 0 AS loss_mask_hashes, count(*) FILTER (WHERE run_branch_id IS NULL) = 0 AS branch_ids FROM ledger),
s AS (SELECT {' + '.join(f'CASE WHEN {k} THEN {v} ELSE 0 END' for k, v in _WEIGHTS.items())} AS points FROM m, e)
SELECT points, {sum(_WEIGHTS.values())} AS most, CASE WHEN points >= {0.95 * sum(_WEIGHTS.values())} THEN 'ready' WHEN points >= {0.75 * sum(_WEIGHTS.values())} THEN 'missing' ELSE 'blocked' END AS verdict FROM s""")
def readiness(m: DataFrame, e: DataFrame) -> DataFrame:
    """The weighted share of the requirements that the tables meet."""
    told = lambda c: F.coalesce(F.col(c), F.lit(False))
    none = lambda c: F.count_if(c) == 0
    first = m.agg(
        (F.countDistinct("tokenizer_hash") == 1).alias("tokenizer_frozen"), none((F.col("admission") == "admitted") & (told("never_train") | told("canary_match") | told("benchmark_derived"))).alias("eval_firewall"),
        none(F.col("eval_overlap_status").isNull()).alias("contamination_scan"), none(F.col("license_tier").isNull()).alias("license_tiers"),
    )
    second = e.agg(none(F.col("opus_decision_id").isNull()).alias("reject_log"), none(F.length(F.coalesce("loss_mask_hash", F.lit(""))) != 64).alias("loss_mask_hashes"), none(F.col("run_branch_id").isNull()).alias("branch_ids"))
    total = sum(_WEIGHTS.values())
    points = sum((F.when(F.col(k), v).otherwise(0) for k, v in _WEIGHTS.items()), F.lit(0))
    return first.join(F.broadcast(second)).select(points.alias("points"), F.lit(total).alias("most"), F.when(points >= 0.95 * total, "ready").when(points >= 0.75 * total, "missing").otherwise("blocked").alias("verdict"))


# -- packing policies over declared lengths ----------------------------------------------------------

POLICIES = ("pad", "chop", "greedy", "best", "structured")


def simulated(lengths: list[int], size: int, policy: str) -> list[list[int]]:
    """Windows of a packing policy over a short list of lengths.

    ``chop`` closes a window when the next document does not fit; ``greedy`` takes the
    window left fullest in the order given, ``best`` the same from the longest down;
    ``structured`` puts at most two documents in the window it takes.
    """
    if policy == "pad":
        return [[n] for n in lengths]
    out: list[list[int]] = []
    if policy == "chop":
        for n in lengths:
            if not out or sum(out[-1]) + n > size:
                out.append([])
            out[-1].append(n)
        return out
    for n in sorted(lengths, reverse=True) if policy == "best" else lengths:
        fitting = [b for b in out if sum(b) + n <= size]
        box = min(fitting, key=lambda b: size - sum(b), default=None)
        if box is None or policy == "structured" and len(box) >= 2:
            out.append(box := [])
        box.append(n)
    return out


@query("b11_packing_simulator")
def packing_simulator(spark: SparkSession) -> DataFrame:
    """Windows, unused positions and use of five policies over declared lengths."""
    rows = []
    for n in (4, 12, 24):
        lengths = [8 + (i * 17 + 13) % 47 for i in range(n)]
        for size in (64, 128):
            for policy in POLICIES:
                bins = simulated(lengths, size, policy)
                rows.append((n, size, policy, len(bins), len(bins) * size - sum(lengths), round(100 * sum(lengths) / (len(bins) * size))))
    return spark.createDataFrame(rows, "n_docs int, size int, policy string, windows int, unused int, used_pct int")


_LENGTHS = [1, 40, 127, 128, 129, 300]


@query("b10_padding_lab", sql=f"""SELECT mode, n, least(n, 128) + CASE WHEN mode = 'concat' THEN greatest(128 - n, 0) ELSE 0 END AS useful, CASE WHEN mode = 'concat' THEN 0 ELSE greatest(128 - n, 0) END AS pads, greatest(n - 128, 0) AS cropped FROM {_values([(n,) for n in _LENGTHS], 'n')}, (VALUES ('right'), ('left'), ('crop'), ('concat')) m(mode)""")
def padding_lab(spark: SparkSession, size: int = 128) -> DataFrame:
    """A document in a window of its own: padded on either side, cropped, or filled up with the next one after an end mark."""
    rows = spark.createDataFrame([(n,) for n in _LENGTHS], "n int").withColumn("mode", F.explode(F.array(*map(F.lit, ("right", "left", "crop", "concat")))))
    n, free = F.col("n"), F.greatest(size - F.col("n"), F.lit(0))
    filled = F.col("mode") == "concat"
    return rows.select("mode", "n", (F.least(n, F.lit(size)) + F.when(filled, free).otherwise(0)).alias("useful"), F.when(filled, 0).otherwise(free).alias("pads"), F.greatest(n - size, F.lit(0)).alias("cropped"))


@query("b12_batch_arithmetic", sql="SELECT g AS gpus, g * 2 * 16 AS global_batch, 2 * 128 AS micro_tokens, g * 2 * 16 * 128 AS step_tokens, g * 2 * 16 * 128 * 10 AS checkpoint_tokens, ceil(2e9 / (g * 2 * 16 * 128))::BIGINT AS epoch_steps FROM (VALUES (1), (8), (64)) t(g)")
def batch_arithmetic(spark: SparkSession) -> DataFrame:
    g = F.col("gpus")
    return spark.createDataFrame([(1,), (8,), (64,)], "gpus int").select("gpus", (g * 32).alias("global_batch"), F.lit(256).alias("micro_tokens"), (g * 4096).alias("step_tokens"), (g * 40960).alias("checkpoint_tokens"), F.ceil(2e9 / (g * 4096)).alias("epoch_steps"))
