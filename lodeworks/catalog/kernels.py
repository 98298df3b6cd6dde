"""Attention kernels as joins: positions of a bounded sequence, scores, softmax by window.

The vectors of ``embeddings`` are taken as sequences of ``LENGTH`` consecutive ids; every
row takes part, and pairs are formed within a sequence only, at most LENGTH squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.catalog.codes import dot
from lodeworks.registry import query

LENGTH = 32


def pairs(e: DataFrame, readable: Column | None = None) -> DataFrame:
    """``seq``, ``i``, ``j``, ``score`` for positions j <= i that are readable; the score is scaled."""
    rows = e.select(F.floor(F.col("vec_id") / LENGTH).alias("seq"), F.pmod("vec_id", F.lit(LENGTH)).alias("p"), "embedding")
    q, k = rows.withColumnsRenamed({"p": "i", "embedding": "q"}), rows.withColumnsRenamed({"p": "j", "embedding": "k"})
    met = q.join(k, "seq").where(F.col("j") <= F.col("i"))
    met = met if readable is None else met.where(readable)
    return met.select("seq", "i", "j", (dot("q", "k") / F.sqrt(F.size("q"))).alias("score"))


def softmax(scored: DataFrame) -> DataFrame:
    """``weight`` of each pair, shifted by the row's maximum."""
    row = Window.partitionBy("seq", "i")
    shifted = scored.withColumn("x", F.exp(F.col("score") - F.max("score").over(row)))
    return shifted.withColumn("weight", F.col("x") / F.sum("x").over(row)).drop("x")


def strongest(scored: DataFrame) -> DataFrame:
    """Per query position the key position of the greatest score, ties to the first, and the number read."""
    return scored.groupBy("seq", "i").agg(F.min_by("j", F.struct(-F.col("score"), "j")).alias("best"), F.count(F.lit(1)).alias("n"))


_DOT = "list_dot_product(q.embedding::DOUBLE[], k.embedding::DOUBLE[])"


def _sql(where: str = "true", bias: str = "0") -> str:
    return f"""WITH p AS (SELECT vec_id // {LENGTH} AS seq, vec_id % {LENGTH} AS p, embedding FROM embeddings), s AS (SELECT q.seq, q.p AS i, k.p AS j, {_DOT} / sqrt(len(q.embedding)) + {bias} AS score FROM p q JOIN p k ON q.seq = k.seq AND k.p <= q.p)
SELECT seq, i, arg_min(j, (-score, j)) AS best, count(*) AS n FROM s WHERE {where} GROUP BY seq, i"""


@query("n01_softmax_attention", "embeddings", sql=_sql())
def causal(e: DataFrame) -> DataFrame:
    return strongest(softmax(pairs(e)).withColumn("score", F.col("score")))


@query("n01_attention_mass", "embeddings", sql=f"""WITH p AS (SELECT vec_id // {LENGTH} AS seq, vec_id % {LENGTH} AS p, embedding FROM embeddings), s AS (SELECT q.seq, q.p AS i, k.p AS j, {_DOT} / sqrt(len(q.embedding)) AS score FROM p q JOIN p k ON q.seq = k.seq AND k.p <= q.p),
w AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY seq, i) AS weight FROM s) SELECT seq, round(sum(weight))::BIGINT AS rows_of_one, count(*) AS n FROM w GROUP BY seq""")
def attention_mass(e: DataFrame) -> DataFrame:
    return softmax(pairs(e)).groupBy("seq").agg(F.round(F.sum("weight")).cast("long").alias("rows_of_one"), F.count(F.lit(1)).alias("n"))


@query("n08_window", "embeddings", sql=_sql("(i - j <= 8 AND (i - j) % 2 = 0) OR j = 0"))
def sliding(e: DataFrame) -> DataFrame:
    gap = F.col("i") - F.col("j")
    return strongest(pairs(e, ((gap <= 8) & (gap % 2 == 0)) | (F.col("j") == 0)))


@query("n05_segments", "embeddings", sql=_sql("j >= (i // 8) * 8 - 8"))
def segments(e: DataFrame) -> DataFrame:
    return strongest(pairs(e, F.col("j") >= F.floor(F.col("i") / 8) * 8 - 8))


@query("n06_sparse", "embeddings", sql=_sql("i - j < 4 OR (i - j) % 4 = 0 OR j % 8 = 7"))
def sparse(e: DataFrame) -> DataFrame:
    gap = F.col("i") - F.col("j")
    return strongest(pairs(e, (gap < 4) | (gap % 4 == 0) | (F.col("j") % 8 == 7)))


@query("n13_alibi", "embeddings", sql=_sql(bias="(-(q.p - k.p) * 0.0625)"))
def alibi(e: DataFrame) -> DataFrame:
    return strongest(pairs(e).withColumn("score", F.col("score") - (F.col("i") - F.col("j")) * 0.0625))


@query("n03_relative_buckets", "embeddings", sql=_sql(bias="0.01 * greatest(k.p - q.p, -4)"))
def relative(e: DataFrame) -> DataFrame:
    return strongest(pairs(e).withColumn("score", F.col("score") + 0.01 * F.greatest(F.col("j") - F.col("i"), F.lit(-4))))


@query("n19_sinks", "embeddings", sql=_sql("j < 2 OR j >= i - 5"))
def sinks(e: DataFrame) -> DataFrame:
    return strongest(pairs(e, (F.col("j") < 2) | (F.col("j") >= F.col("i") - 5)))


@query("n25_top_k", "embeddings", sql=f"""WITH p AS (SELECT vec_id // {LENGTH} AS seq, vec_id % {LENGTH} AS p, embedding FROM embeddings), s AS (SELECT q.seq, q.p AS i, k.p AS j, {_DOT} / sqrt(len(q.embedding)) AS score FROM p q JOIN p k ON q.seq = k.seq AND k.p <= q.p)
SELECT seq, i, j FROM s QUALIFY row_number() OVER (PARTITION BY seq, i ORDER BY score DESC, j) <= 4""")
def top_k(e: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("seq", "i").orderBy(F.desc("score"), "j"))
    return pairs(e).withColumn("r", rank).where("r <= 4").select("seq", "i", "j")


@query("n24_blocks", "embeddings", sql=f"""WITH p AS (SELECT vec_id // {LENGTH} AS seq, vec_id % {LENGTH} AS p, embedding FROM embeddings), s AS (SELECT q.seq, q.p AS i, k.p // 8 AS block, avg({_DOT}) AS score FROM p q JOIN p k ON q.seq = k.seq AND k.p <= q.p GROUP BY ALL)
SELECT seq, i, arg_min(block, (-score, block)) AS best, count(*) AS n FROM s GROUP BY seq, i""")
def blocks(e: DataFrame) -> DataFrame:
    per = pairs(e).groupBy("seq", "i", F.floor(F.col("j") / 8).alias("j")).agg(F.avg("score").alias("score"))
    return strongest(per)


@query("n14_online_softmax", "embeddings", sql=f"""WITH p AS (SELECT vec_id // {LENGTH} AS seq, vec_id % {LENGTH} AS p, embedding FROM embeddings), s AS (SELECT q.seq, q.p AS i, k.p AS j, {_DOT} / sqrt(len(q.embedding)) AS score FROM p q JOIN p k ON q.seq = k.seq AND k.p <= q.p)
SELECT seq, i, round(1000 * ln(sum(exp(score))))::BIGINT AS log_sum FROM s GROUP BY seq, i""")
def online(e: DataFrame) -> DataFrame:
    """The log of the softmax sum from partial (maximum, sum) per tile, merged as a tiled kernel does."""
    tile = pairs(e).withColumn("tile", F.floor(F.col("j") / 8))
    top = tile.groupBy("seq", "i", "tile").agg(F.max("score").alias("m"), F.collect_list("score").alias("all"))
    part = top.select("seq", "i", "m", F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m"))).alias("s"))
    whole = part.groupBy("seq", "i").agg(F.max("m").alias("top"), F.collect_list(F.struct("m", "s")).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["s"] * F.exp(p["m"] - F.col("top")))
    return whole.select("seq", "i", F.round(1000 * (F.col("top") + F.log(total))).cast("long").alias("log_sum"))


@query("n00_kv_cache_bytes", "packing_policy", sql="SELECT lane, 2::BIGINT * 48 * 8 * 128 * seq_len * 2 AS bytes FROM packing_policy")
def kv_cache(p: DataFrame) -> DataFrame:
    return p.select("lane", (F.lit(2 * 48 * 8 * 128 * 2).cast("long") * F.col("seq_len")).alias("bytes"))


# -- kernels with a state, heads, and position formulas ------------------------------------------


def _heads(v: Column, heads: int) -> Column:
    """The vector's equal slices, one per head."""
    size = F.size(v)
    return F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(v, (h * size / heads).cast("int") + 1, (size / heads).cast("int")))


def fold(e: DataFrame, step, out: str = "seq long, p long, norm double") -> DataFrame:
    """A recurrent kernel over each sequence: ``step(state, x)`` gives the new state and the read-out.

    A sequence is bounded by ``LENGTH`` rows, so each is one small group.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", kind="stable")
        xs = np.stack([np.asarray(x, np.float64) for x in pdf["embedding"]])
        state = np.zeros((xs.shape[1], xs.shape[1]))
        norms = []
        for x in xs:
            state, read = step(state, x)
            norms.append(float(np.linalg.norm(read)))
        return pd.DataFrame({"seq": pdf["seq"], "p": pdf["p"], "norm": norms})

    rows = e.select(F.floor(F.col("vec_id") / LENGTH).alias("seq"), F.pmod("vec_id", F.lit(LENGTH)).alias("p"), "embedding")
    return rows.groupBy("seq").applyInPandas(run, out)


def linear_step(s, x):
    s = s + _outer(x, x)
    return s, s @ x


def delta_step(s, x, beta: float = 0.5, gate: float = 1.0):
    s = gate * s
    s = s + beta * _outer(x - s @ x, x)
    return s, s @ x


def _outer(a, b):
    return a[:, None] * b[None, :]


_PREFIX = f"""WITH p AS (SELECT vec_id // {LENGTH} AS seq, vec_id % {LENGTH} AS p, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT q.seq, q.p AS i, k.p AS j, list_dot_product(q.x, k.x) AS d FROM p q JOIN p k ON q.seq = k.seq AND k.p <= q.p)"""


@query("n09_linear_attention", "embeddings", sql=f"{_PREFIX}, o AS (SELECT s.seq, s.i, unnest(range(1, len(k.x) + 1)) AS c, unnest(list_transform(k.x, lambda v: v * s.d)) AS v FROM s JOIN p k ON k.seq = s.seq AND k.p = s.j), c AS (SELECT seq, i, c, sum(v) AS v FROM o GROUP BY ALL) SELECT seq, i AS p, round(sqrt(sum(v * v)) * 1000)::BIGINT AS norm FROM c GROUP BY seq, i")
def linear_attention(e: DataFrame) -> DataFrame:
    return fold(e, linear_step).withColumn("norm", F.round(F.col("norm") * 1000).cast("long"))


@query("n11_delta_rule", "embeddings")
def delta_rule(e: DataFrame) -> DataFrame:
    return fold(e, delta_step)


@query("n23_gated_delta", "embeddings")
def gated_delta(e: DataFrame) -> DataFrame:
    return fold(e, lambda s, x: delta_step(s, x, 0.5, 0.9))


@query("n20_selective_state", "embeddings")
def selective_state(e: DataFrame) -> DataFrame:
    """The decay depends on the token: a larger first component forgets more."""
    return fold(e, lambda s, x: delta_step(s, x, 1.0, 1.0 / (1.0 + abs(float(x[0])))))


@query("n26_bidirectional", "embeddings", sql=f"""WITH p AS (SELECT vec_id // {LENGTH} AS seq, vec_id % {LENGTH} AS p, embedding FROM embeddings), s AS (SELECT q.seq, q.p AS i, k.p AS j, {_DOT} AS score FROM p q JOIN p k ON q.seq = k.seq AND k.p <> q.p)
SELECT seq, i, arg_min(j, (-score, j)) AS best, count(*) AS n FROM s GROUP BY seq, i""")
def bidirectional(e: DataFrame) -> DataFrame:
    rows = e.select(F.floor(F.col("vec_id") / LENGTH).alias("seq"), F.pmod("vec_id", F.lit(LENGTH)).alias("p"), "embedding")
    q, k = rows.withColumnsRenamed({"p": "i", "embedding": "q"}), rows.withColumnsRenamed({"p": "j", "embedding": "k"})
    return strongest(q.join(k, "seq").where("i != j").select("seq", "i", "j", dot("q", "k").alias("score")))


def grouped_scores(e: DataFrame, heads: int, groups: int) -> DataFrame:
    """``seq``, ``i``, ``j``, ``head``, ``score`` where the query heads of a group share one key head, the mean of theirs."""
    rows = e.select(F.floor(F.col("vec_id") / LENGTH).alias("seq"), F.pmod("vec_id", F.lit(LENGTH)).alias("p"), _heads(F.col("embedding"), heads).alias("h"))
    per = heads // groups
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y.cast("double"))
    zero = lambda h: F.transform(h[0], lambda x: F.lit(0.0))
    pooled = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.transform(F.aggregate(F.slice("h", g * per + 1, F.lit(per)), zero(F.col("h")), add), lambda x: x / per))
    q = rows.select("seq", F.col("p").alias("i"), F.posexplode("h").alias("head", "q"))
    k = rows.select("seq", F.col("p").alias("j"), F.posexplode(pooled).alias("g", "k"))
    met = q.join(k, (q["seq"] == k["seq"]) & (F.floor(q["head"] / per) == k["g"]) & (k["j"] <= q["i"])).drop(k["seq"])
    return met.select("seq", "i", "j", "head", (dot("q", "k") / F.sqrt(F.size("q"))).alias("score"))


def _grouped_sql(heads: int, groups: int) -> str:
    per, size = heads // groups, 64 // heads
    key = " + ".join(f"x[(g * {per} + {m}) * {size} + c]" for m in range(per))
    return f"""WITH p AS (SELECT vec_id // {LENGTH} AS seq, vec_id % {LENGTH} AS p, embedding::DOUBLE[] AS x FROM embeddings),
q AS (SELECT seq, p AS i, h AS head, x[h * {size} + 1:(h + 1) * {size}] AS q FROM p, range({heads}) r(h)), k AS (SELECT seq, p AS j, g, list_transform(range(1, {size} + 1), lambda c: ({key}) / {per}.0::DOUBLE) AS k FROM p, range({groups}) r(g)),
s AS (SELECT q.seq, i, j, head, list_dot_product(q, k) / sqrt({size}) AS score FROM q JOIN k ON q.seq = k.seq AND head // {per} = g AND j <= i) SELECT seq, i, head, arg_min(j, (-score, j)) AS best FROM s GROUP BY ALL"""


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("seq", "i", F.col("head").cast("long").alias("head")).agg(F.min_by("j", F.struct(-F.col("score"), "j")).alias("best"))


@query("n15_grouped_heads", "embeddings", sql=_grouped_sql(8, 2))
def grouped_heads(e: DataFrame) -> DataFrame:
    """Eight query heads over two key heads."""
    return _best(grouped_scores(e, 8, 2))


@query("n07_shared_key_head", "embeddings", sql=_grouped_sql(8, 1))
def shared_key_head(e: DataFrame) -> DataFrame:
    """Eight query heads over a single key head."""
    return _best(grouped_scores(e, 8, 1))


def chunked_delta(xs, beta: float = 0.5, size: int = 8):
    """Read-outs of the delta rule worked off in chunks: inside one, a triangular system stands for the steps."""
    import numpy as np

    state = np.zeros((xs.shape[1], xs.shape[1]))
    out = []
    for at in range(0, len(xs), size):
        k = xs[at : at + size]
        inner = k @ k.T
        # u solves (I + beta * lower(K K')) u = beta * (V - K S'): what each step of the chunk writes
        u = np.linalg.solve(np.eye(len(k)) + beta * np.tril(inner, -1), beta * (k - k @ state.T))
        out.append(k @ state.T + np.tril(inner) @ u)
        state = state + u.T @ k
    return np.concatenate(out) if out else np.zeros_like(xs)


@query("n22_chunked_delta", "embeddings")
def delta_in_chunks(e: DataFrame) -> DataFrame:
    """Per sequence the largest difference between the delta rule step by step and in chunks: nothing to speak of."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", kind="stable")
        xs = np.stack([np.asarray(x, np.float64) for x in pdf["embedding"]])
        xs = xs / np.maximum(np.linalg.norm(xs, axis=1, keepdims=True), 1e-300)
        state, reads = np.zeros((xs.shape[1], xs.shape[1])), []
        for x in xs:
            state, read = delta_step(state, x)
            reads.append(read)
        gap = np.abs(np.stack(reads) - chunked_delta(xs)).max()
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "n": [len(xs)], "same": [bool(gap < 1e-9)]})

    rows = e.select(F.floor(F.col("vec_id") / LENGTH).alias("seq"), F.pmod("vec_id", F.lit(LENGTH)).alias("p"), "embedding")
    return rows.groupBy("seq").applyInPandas(run, "seq long, n long, same boolean")


@query("n21_latent_compression", "embeddings")
def latent_compression(e: DataFrame) -> DataFrame:
    """How much of the keys' energy a latent of each rank holds: ``rank`` and ``held_10k``.

    Every partition sums its outer products; the driver sees one small matrix a partition
    of the sum tree, never a vector.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = None
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            cells = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "v"])

    sums = e.where(F.col("embedding").isNotNull()).select("embedding").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    if not sums:
        return e.sparkSession.createDataFrame([], "rank int, held_10k long")
    size = int(round(len(sums) ** 0.5))
    cells = np.zeros(size * size)
    for r in sums:
        cells[r["cell"]] = r["v"]
    values = np.clip(np.linalg.eigvalsh(cells.reshape(size, size))[::-1], 0, None)
    held = np.cumsum(values) / max(values.sum(), 1e-300)
    return e.sparkSession.createDataFrame([(k + 1, int(round(10_000 * v))) for k, v in enumerate(held.tolist())], "rank int, held_10k long")


_INDEXED = f"""{_PREFIX}, w AS (SELECT seq, i, j, d / 8 AS score, greatest(list_dot_product(q.x[1:16], k.x[1:16]), 0) + greatest(list_dot_product(q.x[17:32], k.x[17:32]), 0) AS idx FROM s JOIN p q USING (seq) JOIN p k ON k.seq = s.seq AND k.p = s.j WHERE q.p = s.i),
r AS (SELECT *, row_number() OVER (PARTITION BY seq, i ORDER BY idx DESC, j) <= 4 AS taken, max(score) OVER (PARTITION BY seq, i) AS top FROM w)
SELECT seq, i, round(1000 * ln(sum(exp(score - top)) / sum(exp(score - top)) FILTER (WHERE taken)))::BIGINT AS divergence FROM r GROUP BY seq, i"""


@query("n25_indexer", "embeddings", sql=_INDEXED)
def indexed(e: DataFrame) -> DataFrame:
    """What is lost when each position reads only the four keys that a small index of two heads picks.

    The index sums the positive products of two short heads; the loss is the divergence of
    the weights over the chosen keys from the full softmax, the log of the share they hold.
    """
    rows = e.select(F.floor(F.col("vec_id") / LENGTH).alias("seq"), F.pmod("vec_id", F.lit(LENGTH)).alias("p"), "embedding")
    q, k = rows.withColumnsRenamed({"p": "i", "embedding": "q"}), rows.withColumnsRenamed({"p": "j", "embedding": "k"})
    met = q.join(k, "seq").where(F.col("j") <= F.col("i"))
    head = lambda c, n: F.slice(c, 16 * n + 1, 16)
    index = sum((F.greatest(dot(head("q", n), head("k", n)), F.lit(0.0)) for n in (0, 1)), F.lit(0.0))
    scored = met.select("seq", "i", "j", (dot("q", "k") / F.sqrt(F.size("q"))).alias("score"), index.alias("idx"))
    row = Window.partitionBy("seq", "i")
    ranked = scored.withColumns({"taken": F.row_number().over(row.orderBy(F.desc("idx"), "j")) <= 4, "top": F.max("score").over(row)})
    x = F.exp(F.col("score") - F.col("top"))
    return ranked.groupBy("seq", "i").agg(F.round(1000 * F.log(F.sum(x) / F.sum(F.when(F.col("taken"), x)))).cast("long").alias("divergence"))


_SPOTS = "range(64) p(p), range(0, 64, 2) d(d)"


@query("n02_sinusoidal", sql=f"SELECT p, d, round(1000 * sin(p / pow(10000, d / 64.0)))::BIGINT AS s, round(1000 * cos(p / pow(10000, d / 64.0)))::BIGINT AS c FROM {_SPOTS}")
def sinusoidal(spark) -> DataFrame:
    grid = spark.range(64).toDF("p").withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(62).cast("long"), F.lit(2).cast("long"))))
    angle = F.col("p") / F.pow(F.lit(10000.0), F.col("d") / 64.0)
    return grid.select("p", "d", F.round(1000 * F.sin(angle)).cast("long").alias("s"), F.round(1000 * F.cos(angle)).cast("long").alias("c"))


@query("n12_rope_angles", sql="SELECT s AS stretch, d, round(1e6 / pow(10000, d / 64.0))::BIGINT AS plain, round(1e6 / pow(10000, d / 64.0) / s)::BIGINT AS interpolated, round(1e6 / pow(10000 * pow(s, 64 / 62.0), d / 64.0))::BIGINT AS rebased FROM (VALUES (1), (2), (4), (8)) a(s), range(0, 64, 2) d(d)")
def rope_angles(spark) -> DataFrame:
    """Rotation per position of each pair of dimensions: plain, with positions compressed, with the base changed."""
    grid = spark.createDataFrame([(s,) for s in (1, 2, 4, 8)], "stretch int").withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(62).cast("long"), F.lit(2).cast("long"))))
    part = F.col("d") / 64.0
    plain = 1e6 / F.pow(F.lit(10000.0), part)
    rebased = 1e6 / F.pow(10000.0 * F.pow(F.col("stretch").cast("double"), F.lit(64 / 62.0)), part)
    return grid.select("stretch", "d", F.round(plain).cast("long").alias("plain"), F.round(plain / F.col("stretch")).cast("long").alias("interpolated"), F.round(rebased).cast("long").alias("rebased"))


@query("n18_ramp", sql="SELECT d, round(1000 * least(greatest((d / 2.0 - 4) / 20.0, 0), 1))::BIGINT AS ramp FROM range(0, 64, 2) d(d)")
def ramp(spark) -> DataFrame:
    """How far each pair of dimensions is interpolated between its plain and its compressed rotation."""
    return spark.range(0, 64, 2).toDF("d").select("d", F.round(1000 * F.least(F.greatest((F.col("d") / 2.0 - 4) / 20.0, F.lit(0.0)), F.lit(1.0))).cast("long").alias("ramp"))


@query("n10_random_features", "embeddings")
def random_features(e: DataFrame) -> DataFrame:
    """Positive random features exp(w.x - |x|^2 / 2) for 16 seeded directions: their mean estimates the softmax kernel."""
    import random

    gen = random.Random(11)
    size = 64
    ws = [[gen.gauss(0, 1) for _ in range(size)] for _ in range(16)]
    half = dot("embedding", "embedding") / 2
    feature = lambda w: F.exp(dot(F.array(*map(F.lit, w)), F.col("embedding")) - half)
    return e.select("vec_id", (sum((feature(w) for w in ws[1:]), feature(ws[0])) / len(ws)).alias("mean_feature"))
