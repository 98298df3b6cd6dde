"""Mixtures, curricula, decisions, packing and throughput: queries over the plan tables and documents."""

from __future__ import annotations

import bisect
import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.catalog.texts import _D, _words
from lodeworks.functions import hashing as H
from lodeworks.functions import text as T
from lodeworks.operators.cleaning import running
from lodeworks.registry import query

# Stage bands, phases with their loss factors, floors in percent, accept threshold in ten thousandths.
STAGES = (("foundation", 0.0, 0.55), ("skill_build", 0.55, 0.85), ("anneal", 0.85, 1.0))
PHASES = (("early", 0.4, 135), ("mid", 0.7, 95), ("late", 0.85, 72), ("anneal", 1.01, 62))
FLOORS = {"indic": 3.0, "reasoning": 3.0, "agentic": 2.0}
ACCEPT = 2800
WINDOW_TOKENS = 128


@query("x01_stage_bands", "ledger", sql="SELECT stage, phase, count(*) AS n FROM (SELECT CASE WHEN f < 5500 THEN 'foundation' WHEN f < 8500 THEN 'skill_build' ELSE 'anneal' END AS stage, CASE WHEN f < 4000 THEN 'early' WHEN f < 7000 THEN 'mid' WHEN f < 8500 THEN 'late' ELSE 'anneal' END AS phase FROM (SELECT least(ledger_offset * 10000 // (SELECT max(ledger_offset) + 1 FROM ledger), 9999) AS f FROM ledger)) GROUP BY ALL")
def stage_bands(e: DataFrame) -> DataFrame:
    """Events by stage and phase, the run being as long as the table's offsets go."""
    whole = F.broadcast(e.agg((F.max("ledger_offset") + 1).alias("whole")))
    e = e.select("ledger_offset").join(whole)
    f = F.least(F.expr("ledger_offset * 10000 div whole"), F.lit(9999))
    stage = F.when(f < 5500, "foundation").when(f < 8500, "skill_build").otherwise("anneal")
    phase = F.when(f < 4000, "early").when(f < 7000, "mid").when(f < 8500, "late").otherwise("anneal")
    return e.groupBy(stage.alias("stage"), phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"))


#: Share of batches that decisions are taken to turn away when needs are worked out.
REJECTED = 0.18


@query("x03_feasibility", "mixture", "manifest", sql=f"""WITH s AS (SELECT lower(trim(capability_lane)) AS lane, sum(n)::BIGINT AS supply FROM (SELECT shard_id, max(capability_lane) AS capability_lane, max(token_count) AS n FROM manifest WHERE admission = 'admitted' AND token_count > 0 GROUP BY 1) GROUP BY 1)
SELECT stage, lane, round(token_budget * share_pct / 100 / (1 - {REJECTED}))::BIGINT AS need, coalesce(supply, 0) AS supply, coalesce(supply, 0) < token_budget * share_pct / 100 / (1 - {REJECTED}) AS short FROM mixture LEFT JOIN s USING (lane)""")
def feasibility(x: DataFrame, m: DataFrame) -> DataFrame:
    """Tokens that each stage and lane needs, what is lost to decisions included, against what is admitted."""
    held = m.where("admission = 'admitted' and token_count > 0").groupBy("shard_id").agg(F.max("capability_lane").alias("lane"), F.max("token_count").alias("n"))
    supply = held.groupBy(F.lower(F.trim("lane")).alias("lane")).agg(F.sum("n").alias("supply"))
    need = F.col("token_budget") * F.col("share_pct") / 100 / (1 - REJECTED)
    rows = x.join(supply, "lane", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    return rows.select("stage", "lane", F.round(need).cast("long").alias("need"), "supply", (F.col("supply") < need).alias("short"))


@query("x03_recorded_needs", "feasibility", sql="SELECT stage, lane, max(need) AS need, max(supply) AS supply, coalesce(max(supply), 0) < max(need) AS short FROM feasibility GROUP BY ALL")
def recorded_needs(f: DataFrame) -> DataFrame:
    per = f.groupBy("stage", "lane").agg(F.max("need").alias("need"), F.max("supply").alias("supply"))
    return per.withColumn("short", F.coalesce("supply", F.lit(0)) < F.col("need"))


@query("x13_repetition", "feasibility", "mixture", sql="SELECT f.stage, f.lane, ceil(f.need / f.supply)::BIGINT AS repeats, m.max_repeats, ceil(f.need / f.supply) > m.max_repeats AS over FROM (SELECT stage, lane, max(need) AS need, max(supply) AS supply FROM feasibility GROUP BY ALL) f JOIN mixture m USING (stage, lane) WHERE f.supply > 0")
def repetition(f: DataFrame, m: DataFrame) -> DataFrame:
    per = f.groupBy("stage", "lane").agg(F.max("need").alias("need"), F.max("supply").alias("supply")).where("supply > 0")
    times = F.ceil(F.col("need") / F.col("supply"))
    return per.join(m, ["stage", "lane"]).select("stage", "lane", times.alias("repeats"), "max_repeats", (times > F.col("max_repeats")).alias("over"))


@query("a08_planned_shares", "mixture", sql="SELECT lane, sum((band_hi - band_lo) * share_pct) AS share FROM mixture GROUP BY lane")
def planned_shares(m: DataFrame) -> DataFrame:
    return m.groupBy("lane").agg(F.sum((F.col("band_hi") - F.col("band_lo")) * F.col("share_pct")).alias("share"))


@query("x10_timeline", "mixture", sql="SELECT stage, lane, share_pct + CASE WHEN stage = 'anneal' THEN CASE lane WHEN 'general' THEN -8 WHEN 'reasoning' THEN 5 WHEN 'agentic' THEN 3 ELSE 0 END ELSE 0 END AS adjusted FROM mixture")
def timeline(m: DataFrame) -> DataFrame:
    shift = F.when(F.col("lane") == "general", -8).when(F.col("lane") == "reasoning", 5).when(F.col("lane") == "agentic", 3).otherwise(0)
    return m.select("stage", "lane", (F.col("share_pct") + F.when(F.col("stage") == "anneal", shift).otherwise(0)).alias("adjusted"))


@query("w10_largest_remainder", "mixture", sql="""WITH t AS (SELECT stage, lane, share_pct * 0.37 AS x FROM mixture), f AS (SELECT *, floor(x)::BIGINT AS w, row_number() OVER (PARTITION BY stage ORDER BY x - floor(x) DESC, lane) AS r FROM t)
SELECT stage, lane, w + CASE WHEN r <= 37 - sum(w) OVER (PARTITION BY stage) THEN 1 ELSE 0 END AS units FROM f""")
def largest_remainder(m: DataFrame) -> DataFrame:
    x = m.select("stage", "lane", (F.col("share_pct") * 0.37).alias("x")).withColumn("w", F.floor("x"))
    rank = F.row_number().over(Window.partitionBy("stage").orderBy(F.desc(F.col("x") - F.col("w")), "lane"))
    spare = F.lit(37) - F.sum("w").over(Window.partitionBy("stage"))
    return x.withColumns({"r": rank, "spare": spare}).select("stage", "lane", (F.col("w") + F.when(F.col("r") <= F.col("spare"), 1).otherwise(0)).alias("units"))


# Why a batch is not taken; the last three do not arise here.
REASONS = ("eval_firewall_overlap", "deferred_for_anneal", "below_proxy_threshold", "lane_quota_full", "duplicate_update_direction", "stage_mismatch")
_UNDER = " OR ".join(f"(lane = '{k}' AND 100 * n < {v} * total)" for k, v in FLOORS.items())
_DECIDED = f"""e AS (SELECT DISTINCT ON (ledger_offset) ledger_offset, mixture_lane AS lane, curriculum_stage AS stage, coalesce(opus_decision_id, 'step-' || ledger_offset) AS candidate, shard_ids FROM ledger WHERE event = 'batch_committed'),
bad AS (SELECT DISTINCT shard_id FROM manifest WHERE coalesce(never_train, false) OR coalesce(benchmark_overlap_pct, 0) > 25 OR coalesce(canary_match, false) OR coalesce(benchmark_derived, false)),
hit AS (SELECT DISTINCT ledger_offset FROM (SELECT ledger_offset, unnest(shard_ids) AS shard_id FROM e) SEMI JOIN bad USING (shard_id)),
share AS (SELECT *, sum(n) OVER (PARTITION BY stage) AS total FROM (SELECT stage, lane, count(*) AS n FROM e WHERE lane IS NOT NULL GROUP BY stage, lane)), floors AS (SELECT stage, lane, {_UNDER} AS under FROM share),
s AS (SELECT e.*, h.ledger_offset IS NOT NULL AS tripped, coalesce(under, false) AS under, CASE WHEN h.ledger_offset IS NOT NULL THEN 0 ELSE (('0x' || substr(sha256(candidate), 1, 8))::BIGINT * 10000) // 4294967296 END AS score FROM e LEFT JOIN hit h USING (ledger_offset) LEFT JOIN floors USING (stage, lane)),
d AS (SELECT *, CASE WHEN tripped THEN 'rejected' WHEN score >= {ACCEPT} THEN 'accepted' WHEN under THEN 'protected' WHEN stage = 'foundation' AND lane IN ('indic', 'reasoning') THEN 'deferred' ELSE 'rejected' END AS decision FROM s)"""


def decided(e: DataFrame, m: DataFrame) -> DataFrame:
    """Committed batches with ``score``, ``decision``, ``reason`` and ``override``, whether a lane's floor had a part in it.

    A batch with a shard that any of the four gates stops is turned away; else its score
    decides, else its lane's floor, else it may be kept for the last stage.
    """
    from lodeworks.catalog.manifest import gates

    rows = e.where("event = 'batch_committed'").dropDuplicates(["ledger_offset"]).select(
        "ledger_offset", F.col("mixture_lane").alias("lane"), F.col("curriculum_stage").alias("stage"), F.coalesce("opus_decision_id", F.concat(F.lit("step-"), F.col("ledger_offset").cast("string"))).alias("candidate"), "shard_ids"
    )
    bad = m.where(F.size(gates()) > 0).select("shard_id").distinct()
    hit = rows.select("ledger_offset", F.explode("shard_ids").alias("shard_id")).join(bad, "shard_id", "left_semi").select("ledger_offset").distinct().withColumn("tripped", F.lit(True))
    share = rows.where("lane is not null").groupBy("stage", "lane").agg(F.count(F.lit(1)).alias("n"))
    whole = share.groupBy("stage").agg(F.sum("n").alias("total"))
    below = F.lit(False)
    for lane, floor in FLOORS.items():
        below = below | ((F.col("lane") == lane) & (100 * F.col("n") < floor * F.col("total")))
    floors = share.join(whole, "stage").select("stage", "lane", below.alias("under"))
    held = rows.join(hit, "ledger_offset", "left").join(F.broadcast(floors), ["stage", "lane"], "left").fillna(False, ["tripped", "under"])
    held = held.withColumn("score", F.when(F.col("tripped"), F.lit(0).cast("long")).otherwise(H.unit_interval(F.col("candidate"))))
    kept = (F.col("stage") == "foundation") & F.col("lane").isin("indic", "reasoning")
    passed = F.col("score") >= ACCEPT
    decision = F.when(F.col("tripped"), "rejected").when(passed, "accepted").when(F.col("under"), "protected").when(kept, "deferred").otherwise("rejected")
    reason = F.when(F.col("tripped"), REASONS[0]).when(passed | F.col("under"), F.lit(None).cast("string")).when(kept, REASONS[1]).otherwise(REASONS[2])
    return held.select("ledger_offset", "stage", "lane", "score", decision.alias("decision"), reason.alias("reason"), (~F.col("tripped") & F.col("under")).alias("override"))


@query("x06_decision", "ledger", "manifest", sql=f"WITH {_DECIDED} SELECT ledger_offset, stage, lane, score, decision, CASE WHEN tripped THEN '{REASONS[0]}' WHEN decision IN ('accepted', 'protected') THEN NULL WHEN decision = 'deferred' THEN '{REASONS[1]}' ELSE '{REASONS[2]}' END AS reason, NOT tripped AND under AS override FROM d")
def decision(e: DataFrame, m: DataFrame) -> DataFrame:
    return decided(e, m)


@query("a06_decision_counts", "ledger", "manifest", sql=f"WITH {_DECIDED} SELECT stage, decision, n, (turned * 10000 // sum(n) OVER (PARTITION BY stage))::BIGINT AS turned_10k FROM (SELECT stage, decision, count(*) AS n, count(*) FILTER (WHERE decision IN ('rejected', 'deferred')) AS turned FROM d GROUP BY stage, decision)")
def decision_counts(e: DataFrame, m: DataFrame) -> DataFrame:
    """Decisions by stage, and the share of a stage's batches that rejections and deferrals take."""
    per = decided(e, m).groupBy("stage", "decision").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("stage"))
    turned = F.when(F.col("decision").isin("rejected", "deferred"), F.col("n")).otherwise(0)
    return per.select("stage", "decision", "n", F.floor(turned * 10000 / total).alias("turned_10k"))


def control_loop(supply: dict[str, int], shares: dict[str, float], steps: int, tokens: int, seed: int) -> list[tuple[int, str, bool, int]]:
    """Step, lane, whether a floor forced it, and the lane's cursor: a small sequential plan on the driver.

    A lane below its floor is taken first, without a draw; every step moves the lane's cursor.
    """
    gen = random.Random(seed)
    used = dict.fromkeys(shares, 0)
    cursor = dict.fromkeys(shares, 0)
    plan = []
    lanes = [k for k in shares if supply.get(k)]
    for step in range(steps):
        total = sum(used.values())
        forced = next((k for k, floor in FLOORS.items() if k in lanes and (100 * used[k] / total if total else 0.0) < floor), None)
        lane = forced or gen.choices(lanes, [shares[k] for k in lanes])[0]
        plan.append((step, lane, forced is not None, cursor[lane] % supply[lane]))
        cursor[lane] += 1
        used[lane] += tokens
    return plan


@query("x08_plan", "manifest", "mixture")
def plan(m: DataFrame, x: DataFrame) -> DataFrame:
    shards = m.where("admission = 'admitted'").select("shard_id", F.lower(F.trim("capability_lane")).alias("lane")).where("lane is not null").distinct()
    supply = {r["lane"]: r["n"] for r in shards.groupBy("lane").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {r["lane"]: r["share_pct"] for r in x.where("stage = 'foundation'").orderBy("lane").collect()}
    steps = m.sparkSession.createDataFrame(control_loop(supply, shares, 150, 1024, 7), "step int, lane string, forced boolean, at long")
    place = F.row_number().over(Window.partitionBy("lane").orderBy("shard_id")).cast("long")
    numbered = shards.withColumn("place", place).where(F.col("place") <= 150).withColumn("at", F.col("place") - 1).drop("place")
    return F.broadcast(steps).join(numbered, ["lane", "at"]).select("step", "lane", "forced", "shard_id")


@query("w04_round_robin", "manifest", sql="SELECT step, lane, shard_id FROM range(200) r(step), (SELECT lane, shard_id, row_number() OVER (PARTITION BY lane ORDER BY shard_id) - 1 AS pos, count(*) OVER (PARTITION BY lane) AS n FROM (SELECT DISTINCT lower(trim(capability_lane)) AS lane, shard_id FROM manifest WHERE capability_lane IS NOT NULL)) WHERE pos = step % n")
def round_robin(m: DataFrame) -> DataFrame:
    """Shards drawn in turn from each lane; only as many as there are steps are ranked, so a lane of any size is a short list."""
    lanes = m.where("capability_lane is not null").select(F.lower(F.trim("capability_lane")).alias("lane"), "shard_id").distinct()
    place = F.row_number().over(Window.partitionBy("lane").orderBy("shard_id")).cast("long")
    numbered = lanes.withColumn("place", place).where(F.col("place") <= 200).withColumn("at", F.col("place") - 1).drop("place")
    sizes = lanes.groupBy("lane").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))))
    return sizes.withColumn("at", F.pmod("step", "n")).join(numbered, ["lane", "at"]).select("step", "lane", "shard_id")


_ROLE = "^(user|plan|tool_call|observation|response): (.*)$"


@query("x16_trained_tokens", "documents", sql=f"""SELECT doc_id, coalesce(sum(n) FILTER (WHERE role IN ('plan', 'tool_call', 'response')), 0)::BIGINT AS trained, sum(n)::BIGINT AS seen FROM
(SELECT doc_id, regexp_extract(l, '{_ROLE}', 1) AS role, len({_words(f"regexp_extract(l, '{_ROLE}', 2)")}) AS n FROM (SELECT doc_id, unnest(string_split({_D}, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '{_ROLE}')) GROUP BY doc_id""")
def trained_tokens(d: DataFrame) -> DataFrame:
    from lodeworks.operators.cleaning import turns

    rows = turns(d).select("doc_id", "role", F.size(T.words(F.col("said"))).alias("n"))
    mine = F.col("role").isin("plan", "tool_call", "response")
    return rows.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias("trained"), F.sum("n").alias("seen"))


# -- packing -----------------------------------------------------------------------------------

_LEN = f"len({_words(_D)})"


def lengths(d: DataFrame) -> DataFrame:
    """``doc_id``, ``lane``, ``n`` words of the documents that have any."""
    return d.select("doc_id", F.coalesce("lane", F.lit("none")).alias("lane"), F.size(T.words(T.text_of("text"))).alias("n")).where("n > 0")


@query("b02_one_doc_bins", "documents", sql=f"SELECT doc_id, least({_LEN}, {WINDOW_TOKENS}) AS used, greatest({_LEN} - {WINDOW_TOKENS}, 0) AS cropped FROM documents WHERE {_LEN} > 0")
def one_doc_bins(d: DataFrame) -> DataFrame:
    return lengths(d).select("doc_id", F.least("n", F.lit(WINDOW_TOKENS)).cast("long").alias("used"), F.greatest(F.col("n") - WINDOW_TOKENS, F.lit(0)).cast("long").alias("cropped"))


@query("b03_concat_chop", "documents", sql=f"""WITH l AS (SELECT doc_id, {_LEN} + 1 AS n FROM documents WHERE {_LEN} > 0), s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM l),
x AS (SELECT doc_id, pos, n, unnest(range(pos // {WINDOW_TOKENS}, (pos + n - 1) // {WINDOW_TOKENS} + 1)) AS bin FROM s)
SELECT bin, doc_id, greatest(pos, bin * {WINDOW_TOKENS}) - pos AS start, least(pos + n, (bin + 1) * {WINDOW_TOKENS}) - pos AS stop FROM x""")
def concat_chop(d: DataFrame) -> DataFrame:
    """All documents with an end mark each, one after another, cut into windows."""
    rows = running(lengths(d).select("doc_id", (F.col("n") + 1).alias("n")), "doc_id", "n").withColumnRenamed("before", "at")
    size = WINDOW_TOKENS
    bins = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))))
    return bins.select("bin", "doc_id", (F.greatest(F.col("at"), F.col("bin") * size) - F.col("at")).alias("start"), (F.least(F.col("at") + F.col("n"), (F.col("bin") + 1) * size) - F.col("at")).alias("stop"))


class Rooms:
    """Free room of bins in the order they were opened; finds the first that holds a size in logarithmic time."""

    def __init__(self, capacity: int):
        self.capacity, self.n, self.width = capacity, 0, 1
        self.tree = [capacity, capacity]

    def first(self, size: int) -> int:
        """The first bin with room for ``size``, opened if none has it."""
        at = 1
        while at < self.width:
            at = 2 * at if self.tree[2 * at] >= size else 2 * at + 1
        bin_ = at - self.width
        if bin_ >= self.n:
            self.n = bin_ + 1
        self.tree[at] -= size
        while at > 1:
            at //= 2
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])
        if self.n == self.width:  # all are open: as many more
            rooms = self.tree[self.width :] + [self.capacity] * self.width
            self.width *= 2
            self.tree = [0] * self.width + rooms
            for i in range(self.width - 1, 0, -1):
                self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])
        return bin_


def first_fitting(sizes, capacity: int) -> list[int]:
    """First fit in the order given."""
    rooms = Rooms(capacity)
    return [rooms.first(n) for n in sizes]


def best_fitting(sizes, capacity: int) -> list[int]:
    """The bin of each size that it leaves the least room in; of equal rooms the bin opened first."""
    rooms: list[tuple[int, int]] = []
    out, opened = [], 0
    for n in sizes:
        k = bisect.bisect_left(rooms, (n, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b, opened = capacity, opened, opened + 1
        bisect.insort(rooms, (room - n, b))
        out.append(b)
    return out


def fitted(d: DataFrame, best: bool, size: int = 1024, chunk: int = 1_000_000) -> DataFrame:
    """``lane``, ``chunk``, ``doc_id``, ``n``, ``bin``: first fit in order of ids, or best fit by falling length.

    Documents above ``size`` are cut to it. Packing is sequential, so a lane of more than
    ``chunk`` documents is cut by a hash of the id into chunks that are packed apart.
    """

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "doc_id"], ascending=[False, True]) if best else pdf.sort_values("doc_id")
        sizes = [min(int(n), size) for n in pdf["n"]]
        return pdf.assign(bin=(best_fitting if best else first_fitting)(sizes, size))[["lane", "chunk", "doc_id", "n", "bin"]]

    rows = lengths(d)
    counts = rows.groupBy("lane").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("chunks"))
    cut = rows.join(counts, "lane").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).drop("chunks")
    return cut.groupBy("lane", "chunk").applyInPandas(place, "lane string, chunk long, doc_id long, n int, bin long")


# First fit and best fit by recursion, a step a document, the rooms of a lane's bins in a list.
def _fit_sql(order: str, pick: str) -> str:
    return f"""WITH RECURSIVE l AS (SELECT doc_id, coalesce(lane, 'none') AS lane, {_LEN} AS n FROM documents WHERE {_LEN} > 0), o AS (SELECT *, least(n, 1024) AS size, row_number() OVER (PARTITION BY lane ORDER BY {order}) AS step FROM l),
r AS (SELECT lane, 0::BIGINT AS step, []::BIGINT[] AS rooms, 0::BIGINT AS bin FROM (SELECT DISTINCT lane FROM o)
UNION ALL SELECT lane, step, CASE WHEN spot > len(rooms) THEN list_append(rooms, 1024 - size) ELSE list_concat(rooms[1:spot - 1], [rooms[spot] - size], rooms[spot + 1:]) END, spot - 1 FROM
(SELECT o.lane, o.step, o.size, r.rooms, coalesce({pick}, len(r.rooms) + 1)::BIGINT AS spot FROM r JOIN o ON o.lane = r.lane AND o.step = r.step + 1))
SELECT o.lane, 0::BIGINT AS chunk, o.doc_id, o.n, r.bin FROM o JOIN r ON r.lane = o.lane AND r.step = o.step"""


_FIRST = "list_min(list_filter(range(1, len(r.rooms) + 1), lambda i: r.rooms[i] >= o.size))"
_BEST = "list_min(list_transform(list_filter(range(1, len(r.rooms) + 1), lambda i: r.rooms[i] >= o.size), lambda i: r.rooms[i] * 100000000 + i)) % 100000000"


@query("b04_first_fit", "documents", sql=_fit_sql("doc_id", _FIRST))
def first_fit(d: DataFrame) -> DataFrame:
    return fitted(d, best=False).withColumn("n", F.col("n").cast("long"))


@query("b05_best_fit", "documents", sql=_fit_sql("n DESC, doc_id", _BEST))
def best_fit(d: DataFrame) -> DataFrame:
    return fitted(d, best=True).withColumn("n", F.col("n").cast("long"))


def dispatched(d: DataFrame, policy: DataFrame, default: int = 1024, chunk: int = 1_000_000) -> DataFrame:
    """``lane``, ``policy``, ``seq_len``, ``bins``, ``used``: each lane's documents packed by its own policy.

    ``concat_and_chop`` lays documents with an end mark each end to end; ``best_fit`` and
    ``greedy`` place whole documents; all else, and lanes without a policy, give each
    document a window of its own. Documents above a window are cut, except when chopped.
    """
    rules = policy.where("seq_len > 0").groupBy("lane").agg(F.max_by("policy", "seq_len").alias("policy"), F.max("seq_len").alias("seq_len"))
    rows = lengths(d).join(F.broadcast(rules), "lane", "left").fillna({"policy": "one_document", "seq_len": default})
    keys = ["lane", "policy", "seq_len"]
    n = F.least("n", F.col("seq_len")).cast("long")
    chopped = rows.where("policy = 'concat_and_chop'").groupBy(*keys).agg(F.sum(F.col("n") + 1).alias("used")).select(*keys, F.ceil(F.col("used") / F.col("seq_len")).alias("bins"), "used")
    fitting = rows.where("policy in ('best_fit', 'greedy')")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        size, best = int(pdf["seq_len"].iloc[0]), pdf["policy"].iloc[0] == "best_fit"
        pdf = pdf.sort_values(["n", "doc_id"], ascending=[False, True]) if best else pdf.sort_values("doc_id")
        sizes = [min(int(x), size) for x in pdf["n"]]
        bins = (best_fitting if best else first_fitting)(sizes, size)
        return pd.DataFrame({"lane": [pdf["lane"].iloc[0]], "policy": [pdf["policy"].iloc[0]], "seq_len": [size], "bins": [max(bins) + 1], "used": [sum(sizes)]})

    chunks = fitting.groupBy("lane").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("chunks"))
    cut = fitting.join(chunks, "lane").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).drop("chunks")
    placed = cut.groupBy("lane", "chunk").applyInPandas(place, "lane string, policy string, seq_len int, bins long, used long")
    fitted_ = placed.groupBy(*keys).agg(F.sum("bins").alias("bins"), F.sum("used").alias("used"))
    single = rows.where("policy not in ('concat_and_chop', 'best_fit', 'greedy')").groupBy(*keys).agg(F.count(F.lit(1)).alias("bins"), F.sum(n).alias("used"))
    return chopped.unionByName(fitted_).unionByName(single)


@query("b06_dispatch", "documents", "packing_policy")
def dispatch(d: DataFrame, p: DataFrame) -> DataFrame:
    return dispatched(d, p)


@query("w06_position_reset", "documents", sql=f"SELECT lane, sum(n * (n - 1) // 2)::BIGINT AS position_sum, sum(n)::BIGINT AS n FROM (SELECT coalesce(lane, 'none') AS lane, least({_LEN}, {WINDOW_TOKENS}) AS n FROM documents WHERE {_LEN} > 0) GROUP BY lane")
def position_reset(d: DataFrame) -> DataFrame:
    spots = lengths(d).select("lane", F.explode(F.sequence(F.lit(0), F.least("n", F.lit(WINDOW_TOKENS)) - 1)).alias("p"))
    return spots.groupBy("lane").agg(F.sum("p").alias("position_sum"), F.count(F.lit(1)).alias("n"))


# -- shares, lookups and comparisons ---------------------------------------------------------------


@query("a10_reject_share", "manifest", sql="SELECT lower(trim(capability_lane)) AS lane, count(*) FILTER (WHERE admission <> 'admitted') * 10000 // count(*) AS per_10k FROM manifest GROUP BY 1")
def reject_share(m: DataFrame) -> DataFrame:
    return m.groupBy(F.lower(F.trim("capability_lane")).alias("lane")).agg(F.floor(F.count_if(F.col("admission") != "admitted") * 10000 / F.count(F.lit(1))).alias("per_10k"))


@query("a13_collisions_by_script", "documents", sql=f"""WITH t AS (SELECT DISTINCT w FROM (SELECT unnest({_words(_D)}) AS w FROM documents)), k AS (SELECT w, substr(w, 1, 6) AS key, CASE WHEN regexp_matches(w, '^[A-Za-z]') THEN 'latin' ELSE 'other' END AS script FROM t),
c AS (SELECT *, count(*) OVER (PARTITION BY key) AS n_key FROM k) SELECT script, count(*) AS n, count(*) FILTER (WHERE n_key > 1) AS collided, count(*) FILTER (WHERE length(w) > 6) AS cropped, sum(greatest(octet_length(encode(w)) - 6, 0))::BIGINT AS bytes_lost FROM c GROUP BY script""")
def collisions_by_script(d: DataFrame) -> DataFrame:
    from lodeworks.operators.dedup import collided

    tokens = d.select(F.explode(T.words(T.text_of("text"))).alias("w")).distinct().withColumns({"key": F.substring("w", 1, 6), "script": F.when(F.col("w").rlike("^[A-Za-z]"), "latin").otherwise("other")})
    return collided(tokens, "key").groupBy("script").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("collides").alias("collided"), F.count_if(F.length("w") > 6).alias("cropped"), F.sum(F.greatest(F.octet_length("w") - 6, F.lit(0))).alias("bytes_lost")
    )


@query("x02_profile_lookup", "ledger", "mixture", sql="SELECT e.curriculum_stage AS stage, e.mixture_lane AS lane, max(m.share_pct) AS share_pct, count(*) AS n FROM ledger e LEFT JOIN mixture m ON m.stage = e.curriculum_stage AND m.lane = e.mixture_lane GROUP BY ALL")
def profile_lookup(e: DataFrame, m: DataFrame) -> DataFrame:
    counts = e.groupBy(F.col("curriculum_stage").alias("stage"), F.col("mixture_lane").alias("lane")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(m.select("stage", "lane", "share_pct"), ["stage", "lane"], "left")


@query("n04_learned_positions", "documents", sql=f"SELECT n > 512 AS past_last, count(*) AS n_docs, sum(least(n, 512))::BIGINT AS with_row, sum(greatest(n - 512, 0))::BIGINT AS without_row FROM (SELECT {_LEN} AS n FROM documents WHERE {_LEN} > 0) GROUP BY 1")
def learned_positions(d: DataFrame) -> DataFrame:
    """A table of 512 learned positions has a row for each position before its end and none after it."""
    n = F.col("n")
    return lengths(d).groupBy((n > 512).alias("past_last")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.least(n, F.lit(512))).alias("with_row"), F.sum(F.greatest(n - 512, F.lit(0))).alias("without_row"))
