"""Byte codes, vector similarity, rank correlation and residue arithmetic."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.catalog.texts import _D, _words
from lodeworks.functions import text as T
from lodeworks.registry import query
from lodeworks.runtime import Stage

MODULI = (7, 11, 13, 17)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


@query("v04_dropped_bytes", "documents", sql=f"WITH t AS (SELECT DISTINCT unnest({_words(_D)}) AS w FROM documents) SELECT r AS width, count(*) AS n, sum(greatest(octet_length(encode(w)) - r, 0))::BIGINT AS dropped, count(*) FILTER (WHERE octet_length(encode(w)) > r) AS cropped FROM t, (VALUES (16), (32), (48), (64)) x(r) GROUP BY r")
def dropped_bytes(d: DataFrame) -> DataFrame:
    rows = d.select(F.explode(T.words(T.text_of("text"))).alias("w")).distinct().select(F.octet_length("w").alias("n"), F.explode(F.array(*map(F.lit, (16, 32, 48, 64)))).alias("width"))
    return rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("n") - F.col("width"), F.lit(0))).alias("dropped"), F.count_if(F.col("n") > F.col("width")).alias("cropped"))


@query("v05_levenshtein", "name_parts", sql="SELECT a.name_part AS a, b.name_part AS b, levenshtein(a.name_part, b.name_part) AS distance FROM name_parts a JOIN name_parts b ON a.part_id < b.part_id AND a.kind = b.kind AND left(a.name_part, 2) = left(b.name_part, 2)")
def edit_distance(n: DataFrame) -> DataFrame:
    a = n.select(F.col("part_id").alias("i"), F.col("name_part").alias("a"), "kind", F.left("name_part", F.lit(2)).alias("head"))
    b = n.select(F.col("part_id").alias("j"), F.col("name_part").alias("b"), "kind", F.left("name_part", F.lit(2)).alias("head"))
    return a.join(b, ["kind", "head"]).where("i < j").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"))


@query("v06_cosine", "embeddings", sql="""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 1000000) / 1000000 >= 0.5 AS close
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(e: DataFrame) -> DataFrame:
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (cosine("embedding", "other") >= 0.5).alias("close"))


@query("j15_top1", "embeddings", sql="""WITH q AS (SELECT vec_id AS a, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT a, e.vec_id AS b, list_cosine_similarity(x, e.embedding::DOUBLE[]) AS c FROM q JOIN embeddings e ON e.vec_id <> a)
SELECT a AS vec_id, arg_max(b, c) AS nearest FROM s GROUP BY a""")
def top_one(e: DataFrame) -> DataFrame:
    """Nearest other vector of every query vector (ids divisible by 100), against all vectors in blocks."""
    return nearest(e, e.where(F.col("vec_id") % 100 == 0))


#: Bytes of the query vectors that go to every worker at a time.
BLOCK_BYTES = 32_000_000


def nearest(e: DataFrame, asked: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``vec_id`` and ``nearest`` of every asked vector; ties go to the least id.

    The asked vectors stream through the driver and are worked off in blocks of bounded
    bytes, each against all vectors; the best of each is written to the shared folder.
    """
    stage = Stage(e.sparkSession, "nearest")
    parts: list[DataFrame] = []
    held: list[tuple[int, list[float]]] = []

    def close() -> None:
        ids = np.array([i for i, _ in held], np.int64)
        unit = np.array([v for _, v in held], np.float64).reshape(len(held), -1)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        sent = e.sparkSession.sparkContext.broadcast((ids, unit))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, m = sent.value
            best, at = np.full(len(q), -2.0), np.full(len(q), -1, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                theirs = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(theirs), -1)
                c = m @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                c[q[:, None] == theirs[None, :]] = -2.0
                k = c.argmax(axis=1)
                top = c[np.arange(len(q)), k]
                better = top > best
                best[better], at[better] = top[better], theirs[k[better]]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(at), pa.array(best)], names=["vec_id", "b", "c"])

        rows = e.where(F.col("embedding").isNotNull()).select("vec_id", "embedding").mapInArrow(run, "vec_id long, b long, c double").where("b >= 0")
        parts.append(stage.keep(rows.groupBy("vec_id").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("nearest")), f"block{len(parts)}"))
        sent.unpersist()

    for r in asked.where(F.col("embedding").isNotNull()).select("vec_id", "embedding").toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) * len(r[1]) * 8 >= block_bytes:
            close()
            held = []
    if held:
        close()
    found = e.sparkSession.createDataFrame([], "vec_id long, nearest long")
    for part in parts:
        found = found.union(part)
    return found


@query("a15_spearman", "lineitem", sql="""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT round(corr(x, y) * 100000)::BIGINT AS rho FROM r""")
def spearman(d: DataFrame) -> DataFrame:
    """Rank correlation by average ranks; ranks come from counts per value, so no task sorts the table."""

    def ranked(df: DataFrame, c: str) -> DataFrame:
        per = df.groupBy(c).agg(F.count(F.lit(1)).alias("k"))
        cuts = per.select(F.percentile_approx(c, [i / 64 for i in range(1, 64)], 10_000).alias("c")).first()["c"] or []
        at = per.withColumn("range", F.size(F.filter(F.array(*(F.lit(x) for x in sorted(set(cuts)))), lambda x: x < F.col(c))))
        start = at.groupBy("range").agg(F.sum("k").alias("s")).select("range", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        before = F.coalesce(F.sum("k").over(Window.partitionBy("range").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return at.join(F.broadcast(start), "range").select(c, (F.col("start") + before + (F.col("k") + 1) / 2.0).alias(f"r_{c}"))

    both = d.join(ranked(d, "l_quantity"), "l_quantity").join(ranked(d, "l_extendedprice"), "l_extendedprice")
    return both.agg(F.round(F.corr("r_l_quantity", "r_l_extendedprice") * 100000).cast("long").alias("rho"))


@query("v12_mu_law", "events", sql="SELECT event_id, round((sign(x) * ln(1 + 255 * abs(x)) / ln(256) + 1) / 2 * 255)::BIGINT AS code FROM (SELECT event_id, least(greatest(value / 100, -1), 1) AS x FROM events)")
def mu_law(e: DataFrame) -> DataFrame:
    x = F.least(F.greatest(F.col("value") / 100, F.lit(-1.0)), F.lit(1.0))
    code = (F.signum(x) * F.log(1 + 255 * F.abs(x)) / F.log(F.lit(256.0)) + 1) / 2 * 255
    return e.select("event_id", F.round(code).cast("long").alias("code"))


def crt_weights(moduli: tuple[int, ...] = MODULI) -> list[int]:
    """For each modulus the number that is 1 to it and 0 to all others."""
    whole = int(np.prod(moduli))
    return [whole // m * pow(whole // m, -1, m) % whole for m in moduli]


@query("v13_crt", "orders", sql=f"SELECT o_orderkey, ({' + '.join(f'(o_orderkey % {m}) * {w}' for m, w in zip(MODULI, crt_weights(), strict=True))}) % {int(np.prod(MODULI))} AS back FROM orders")
def crt(o: DataFrame) -> DataFrame:
    parts = [F.pmod("o_orderkey", F.lit(m)) * w for m, w in zip(MODULI, crt_weights(), strict=True)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return o.select("o_orderkey", F.pmod(total, F.lit(int(np.prod(MODULI)))).alias("back"))


@query("v14_residues", "lineitem", sql="SELECT l_orderkey, l_linenumber, (l_orderkey + l_partkey) % 97 AS added, ((l_orderkey % 97) * (l_partkey % 97)) % 97 AS product, ((l_orderkey - l_partkey) % 97 + 97) % 97 AS difference FROM lineitem")
def residues(d: DataFrame) -> DataFrame:
    a, b, p = F.col("l_orderkey"), F.col("l_partkey"), F.lit(97)
    return d.select("l_orderkey", "l_linenumber", F.pmod(a + b, p).alias("added"), F.pmod(F.pmod(a, p) * F.pmod(b, p), p).alias("product"), F.pmod(a - b, p).alias("difference"))


@query("v16_cost_curves", sql="SELECT v AS vocab, d AS dim, v * d AS full_params, v * 64 + 64 * d AS factored FROM (VALUES (32000), (50000), (250000)) a(v), (VALUES (512), (4096)) b(d)")
def cost_curves(spark: SparkSession) -> DataFrame:
    grid = spark.createDataFrame([(v, d) for v in (32000, 50000, 250000) for d in (512, 4096)], "vocab int, dim int")
    return grid.select("vocab", "dim", (F.col("vocab") * F.col("dim")).alias("full_params"), (F.col("vocab") * 64 + 64 * F.col("dim")).alias("factored"))


@query("v17_byte_budget", "documents", sql=f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE octet_length(encode(w)) <= 16) AS fits FROM (SELECT lang, unnest({_words(_D)}) AS w FROM documents) GROUP BY lang")
def byte_budget(d: DataFrame) -> DataFrame:
    return d.select("lang", F.explode(T.words(T.text_of("text"))).alias("w")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.octet_length("w") <= 16).alias("fits"))


@query("v18_zipf", "documents", sql=f"WITH c AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest({_words(_D)}) AS w FROM documents) GROUP BY w) SELECT word, n, rank, round(1000000 / pow(rank, 1.1))::BIGINT AS weight FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS rank FROM c)")
def zipf(d: DataFrame, exponent: float = 1.1) -> DataFrame:
    """Every word with its count, its rank by count (ties share one) and the weight of that rank.

    Ranks come from how many words have each count, a small table, so no task sorts the words.
    """
    words = d.select(F.explode(T.words(T.text_of("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    sizes = words.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = sizes.select("n", (F.coalesce(before, F.lit(0)) + 1).alias("rank"))
    return words.join(ranks, "n").select("word", "n", "rank", F.round(1000000 / F.pow("rank", F.lit(exponent))).cast("long").alias("weight"))


@query("v19_bigrams", "documents", sql=f"SELECT p.a AS a, p.b AS b, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(ws)), lambda i: {{'a': ws[i], 'b': ws[i + 1]}})) AS p FROM (SELECT {_words(_D)} AS ws FROM documents)) GROUP BY 1, 2")
def bigrams(d: DataFrame) -> DataFrame:
    """Neighbouring words and how often they stand together, from each text's own list of words."""
    rows = d.select(T.words(T.text_of("text")).alias("w")).where(F.size("w") > 1)
    n = F.size("w") - 1
    pairs = rows.select(F.slice("w", F.lit(1), n).alias("a"), F.slice("w", F.lit(2), n).alias("b")).select(F.explode(F.arrays_zip("a", "b")).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


# -- byte codes ------------------------------------------------------------------------------------

SCHEMES = ("trunc", "wrap", "ends", "squeeze", "squeeze_all")
WIDTHS = (16, 32, 48, 64)


def slots(length: int, width: int, scheme: str) -> list[int]:
    """The slot of each byte of a word of this length, -1 for one that is dropped.

    ``trunc`` drops the tail, ``wrap`` starts again from the first slot, ``ends`` keeps head
    and tail, ``squeeze`` shares slots in proportion; all leave words that fit as they are,
    but for ``squeeze_all``.
    """
    if scheme == "squeeze_all" or scheme == "squeeze" and length > width:
        return [i * width // length for i in range(length)]
    if scheme == "wrap":
        return [i % width for i in range(length)]
    if scheme == "ends" and length > width:
        half = width // 2
        return [i if i < half else i - length + width if i >= length - (width - half) else -1 for i in range(length)]
    return [i if i < width else -1 for i in range(length)]


def grid(word: bytes, width: int, scheme: str = "wrap") -> dict[tuple[int, int], int]:
    """How often each byte stands in each slot."""
    cells: dict[tuple[int, int], int] = {}
    for b, s in zip(word, slots(len(word), width, scheme), strict=True):
        if s >= 0:
            cells[b, s] = cells.get((b, s), 0) + 1
    return cells


def grid_key(word: bytes, width: int, scheme: str = "wrap") -> tuple:
    """The filled cells of a word's grid, their counts divided by their common divisor."""
    cells = grid(word, width, scheme)
    k = gcd(*cells.values()) if cells else 1
    return tuple(sorted((b, s, n // k) for (b, s), n in cells.items()))


def dense_code(word: bytes, width: int, scheme: str) -> np.ndarray:
    """The code of a word: its grid over the root of its bytes, brought to mean 0 and deviation 1."""
    code = np.zeros(256 * width)
    kept = sum(s >= 0 for s in slots(len(word), width, scheme))
    for (b, s), n in grid(word, width, scheme).items():
        code[b * width + s] = n / kept**0.5
    return (code - code.mean()) / (code.std(ddof=1) + 1e-8)


def decoded_code(code: np.ndarray, width: int) -> bytes:
    """The strongest byte of each slot above the mean, up to the first empty slot."""
    at = code.reshape(256, width)
    filled = at.max(axis=0) > at.mean() + 1e-6
    end = width if filled.all() else int(np.argmin(filled))
    return bytes(at.argmax(axis=0)[:end].tolist())


def read_back(word: bytes, width: int, scheme: str) -> bytes:
    """What ``decoded_code`` makes of ``dense_code``, from the filled cells alone."""
    best: dict[int, tuple[int, int]] = {}
    for (b, s), n in grid(word, width, scheme).items():
        if s not in best or (n, -b) > best[s]:
            best[s] = (n, -b)
    out: list[int] = []
    while len(out) in best:
        out.append(-best[len(out)][1])
    return bytes(out)


def _coded(d: DataFrame) -> DataFrame:
    """Distinct words with, per width and scheme, the key of their code, the bytes dropped and whether it decodes exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
        for batch in batches:
            rows = []
            for w in batch.column(0).to_pylist():
                raw = w.encode("utf-8", "surrogatepass")
                for r in WIDTHS:
                    for scheme in SCHEMES:
                        lost = sum(s < 0 for s in slots(len(raw), r, scheme))
                        key = hashlib.blake2b(repr(grid_key(raw, r, scheme)).encode(), digest_size=8).digest()
                        rows.append((w, r, scheme, int.from_bytes(key, "big", signed=True), lost, len(raw) <= r, read_back(raw, r, scheme) == raw))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["word", "width", "scheme", "key", "lost", "fits", "exact"])

    words = d.select(F.explode(T.words(T.text_of("text"))).alias("w")).distinct()
    return words.mapInArrow(run, "word string, width int, scheme string, key long, lost int, fits boolean, exact boolean")


@query("v04_survey", "documents")
def code_survey(d: DataFrame) -> DataFrame:
    """Per script, width and scheme: words, those whose code another word has, those cropped, and bytes lost."""
    per = _coded(d).groupBy("width", "scheme", "key", T.script(F.col("word")).alias("script")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lost") > 0).alias("cropped"), F.sum("lost").alias("bytes_lost"))
    per = Stage(d.sparkSession, "survey").keep(per, "per")
    whole = per.groupBy("width", "scheme", "key").agg(F.sum("n").alias("all"))
    rows = per.join(whole, ["width", "scheme", "key"])
    shared = F.coalesce(F.sum(F.when(F.col("all") > 1, F.col("n"))), F.lit(0))
    return rows.groupBy("width", "scheme", "script").agg(F.sum("n").alias("n"), shared.alias("collided"), F.sum("cropped").alias("cropped"), F.sum("bytes_lost").alias("bytes_lost"))


@query("a16_exact_decode", "documents")
def exact_decode(d: DataFrame) -> DataFrame:
    """Words that decode to themselves, by width, scheme and whether they fit."""
    return _coded(d).groupBy("width", "scheme", "fits").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("n_exact"))


_ROLE_SLOTS = {
    "trunc": "CASE WHEN i < 8 THEN i ELSE -1 END", "wrap": "i % 8", "ends": "CASE WHEN l <= 8 OR i < 4 THEN i WHEN i >= l - 4 THEN i - l + 8 ELSE -1 END",
    "squeeze": "CASE WHEN l <= 8 THEN i ELSE i * 8 // l END", "squeeze_all": "i * 8 // l",
}
_SLOTTED = " UNION ALL ".join(f"SELECT '{k}' AS scheme, ({v})::BIGINT AS slot FROM b" for k, v in _ROLE_SLOTS.items())


@query("v01_role_slots", "documents", sql=f"WITH b AS (SELECT l, unnest(range(l)) AS i FROM (SELECT octet_length(encode(w)) AS l FROM (SELECT unnest({_words(_D)}) AS w FROM documents))), p AS ({_SLOTTED}) SELECT scheme, slot, count(*) AS n FROM p GROUP BY ALL")
def role_slots(d: DataFrame) -> DataFrame:
    """How many bytes of the corpus each of five schemes puts in each of eight slots; -1 for those it drops.

    Positions depend on the length alone, so they are worked out once per length.
    """
    sizes = d.select(F.explode(T.words(T.text_of("text"))).alias("w")).groupBy(F.octet_length("w").cast("long").alias("l")).agg(F.count(F.lit(1)).alias("k"))
    spots = sizes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("l") - 1)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("scheme"), F.expr(v.replace("//", "div")).cast("long").alias("slot")) for k, v in _ROLE_SLOTS.items()))).alias("p")
    return spots.select("k", each).groupBy("p.scheme", "p.slot").agg(F.sum("k").alias("n"))


def orthonormal(rows: int, size: int, seed: int = 5) -> np.ndarray:
    """A seeded random matrix of ``rows`` by ``size`` with orthonormal columns."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(rows, size)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def recovered(words: list[bytes], width: int, basis: np.ndarray) -> list[bytes]:
    """Words of known length read back from their codes after projection to the basis and back."""
    cells = np.zeros((len(words), 256 * width), np.float32)
    for i, w in enumerate(words):
        for at, b in enumerate(w[:width]):
            cells[i, b * width + at] = 1 / max(1, min(len(w), width)) ** 0.5
    back = ((cells @ basis) @ basis.T).reshape(len(words), 256, width).argmax(axis=1)
    return [bytes(row[: min(len(w), width)].tolist()) for w, row in zip(words, back, strict=True)]


@query("v09_projection_recovery", "documents")
def projection_recovery(d: DataFrame, width: int = 16, sizes: tuple[int, ...] = (64, 256, 1024)) -> DataFrame:
    """How many of the words that fit come back exactly through random projections, by dimensions and length band."""
    sent = d.sparkSession.sparkContext.broadcast({n: orthonormal(256 * width, n) for n in sizes})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = sent.value
        for batch in batches:
            words = [w.encode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
            for at in range(0, len(words), 512):  # codes are dense: a few hundred at a time
                part = words[at : at + 512]
                for n, basis in bases.items():
                    same = [a == b for a, b in zip(part, recovered(part, width, basis), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(part), pa.int32()), pa.array(list(map(len, part)), pa.int32()), pa.array(same, pa.bool_())], names=["size", "length", "exact"])

    words = d.select(F.explode(T.words(T.text_of("text"))).alias("w")).distinct().where(F.octet_length("w") <= width)
    band = F.when(F.col("length") <= 4, "1-4").when(F.col("length") <= 8, "5-8").otherwise("9-16")
    return words.mapInArrow(run, "size int, length int, exact boolean").groupBy("size", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("n_exact"))


def phasors(size: int, seed: int) -> np.ndarray:
    return np.exp(1j * np.random.default_rng(seed).uniform(-np.pi, np.pi, size))


@query("v07_phasor_recovery", "name_parts")
def phasor_recovery(n: DataFrame) -> DataFrame:
    """Words bound into one complex vector of 1,024 dimensions and read back byte by byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1024
        letters = np.stack([phasors(size, b) for b in range(256)])
        base = phasors(size, 1000)
        for batch in batches:
            ws = batch.column(0).to_pylist()
            back = []
            for w in ws:
                raw = w.encode()
                bound = sum(letters[b] * base**i for i, b in enumerate(raw))
                back.append(bytes(int((letters.conj() @ (bound * (base**-i))).real.argmax()) for i in range(len(raw))).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(back, pa.string())], names=["word", "back"])

    return n.where("name_part is not null").select("name_part").mapInArrow(run, "word string, back string")
