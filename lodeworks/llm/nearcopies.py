"""Records that share most of their runs of consecutive words.

Two records are near copies when the Jaccard similarity of their sets of distinct
k-word runs reaches a threshold. Records with the same set form one class, of which one
stands for all. Candidates come from banded MinHash signatures; each is compared batch
by batch of its signature, and given up once the posterior probability of reaching the
threshold falls under a chosen miss probability; the survivors are verified on the runs
themselves. Bands whose bucket is crowded are not paired: their records go through an
exact prefix join on their rarest runs instead, so no bucket size loses a pair.

Words are unbroken runs of letters and digits, case ignored, in the form of ``forms``.
A text of fewer than k words is one run of its own, so that equal short texts still
pair; null and blank texts pair with nothing. A record delivered twice counts once.
Columns not named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm import forms
from lodeworks.runtime import Stage

RUN = 5
THRESHOLD = 0.7
HASHES = 128
ROWS = 4
#: Signature positions compared between two looks at the posterior.
BATCH = 32
#: Chance of giving up a pair that reaches the threshold, at each look.
MISS = 1e-5
#: Classes in one bucket up to which its pairs are formed.
CROWD = 40
#: Records up to which the set of candidates is sent to every worker.
MAX_BROADCAST_IDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_SEED = 0x9E3779B97F4A7C15


@functools.cache
def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    gen = np.random.default_rng(20240229)
    a = gen.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, gen.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


#: Pieces between blanks that are remembered, with what they hold.
REMEMBERED = 500_000


class _Pieces(dict):
    """What ``make`` gives for a piece of text between blanks, worked out when first asked for."""

    def __init__(self, make: Callable[[str], tuple]):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> tuple:
        if len(self) > REMEMBERED:
            self.clear()
        made = self[piece] = self.make(piece)
        return made

    def of(self, text: str) -> list:
        """All pieces of the lower-cased text, one after the other."""
        return list(itertools.chain.from_iterable(map(self.__getitem__, text.lower().split())))


_WORDS = _Pieces(lambda piece: tuple(_WORD.findall(piece)))


def words(text: str) -> list[str]:
    return _WORDS.of(text)


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Hasher:
    """64-bit hashes of words and of runs of words; pieces are remembered."""

    def __init__(self):
        self.pieces = _Pieces(lambda piece: tuple(map(_hash, _WORD.findall(piece))))

    def runs(self, text: str, k: int = RUN) -> np.ndarray:
        """Sorted distinct hashes of the runs of k words."""
        found = self.pieces.of(text)
        if len(found) < k:
            return np.array([_hash(" ".join(words(text)) or text.strip())], np.uint64)
        h = np.array(found, np.uint64)
        n = len(h) - k + 1
        made = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                made ^= h[i : i + n]
                made *= np.uint64(_SEED)
                made ^= made >> np.uint64(29)
        made.sort()
        first = np.ones(n, bool)
        np.not_equal(made[1:], made[:-1], out=first[1:])
        return made[first]


def signature(runs: np.ndarray, n: int = HASHES) -> np.ndarray:
    """MinHash values of a set of run hashes, one per permutation."""
    a, b = _mixers(n)
    mixed = (runs ^ (runs >> np.uint64(32))).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    held = np.empty((min(256, len(mixed)), n), np.uint32)
    for at in range(0, len(mixed), 256):  # a block stays in the processor's cache
        part = mixed[at : at + 256]
        x = held[: len(part)]
        np.multiply(part[:, None], a, out=x)
        x += b
        np.minimum(best, x.min(axis=0), out=best)
    return best


@functools.cache
def posterior_cuts(threshold: float, n: int = HASHES, step: int = BATCH, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(compared, least matches): under them the pair reaches the threshold with less than ``miss``.

    The prior is uniform; with m of n positions equal, the posterior is Beta(m+1, n-m+1).
    """
    grid = np.linspace(0, 1, 4001)[1:-1]

    def above(m: int, size: int) -> float:
        log = m * np.log(grid) + (size - m) * np.log1p(-grid)
        mass = np.exp(log - log.max())
        return float(mass[grid >= threshold].sum() / mass.sum())

    return tuple((size, next(m for m in range(size + 1) if above(m, size) >= miss)) for size in range(step, n + 1, step))


def likely(sig_a: np.ndarray, sig_b: np.ndarray, size_a: int, size_b: int, threshold: float) -> bool:
    """Whether sets of these sizes may reach the threshold, by batches of their signatures.

    Equal low bytes stand for equal values: that only lets more pairs through.
    """
    small, large = sorted((size_a, size_b))
    if not small or small < threshold * large:
        return False
    start = matches = 0
    for size, least in posterior_cuts(threshold):
        matches += int(np.count_nonzero(sig_a[start:size] == sig_b[start:size]))
        if matches < least:
            return False
        start = size
    return True


def verified(runs_a: np.ndarray, runs_b: np.ndarray, threshold: float) -> bool:
    """Whether the sets reach the threshold."""
    common = len(np.intersect1d(runs_a, runs_b, assume_unique=True))
    return common >= threshold * (len(runs_a) + len(runs_b) - common) - 1e-9


def _marks(known, k: int, rows: int):
    """id, text, fixes -> id, class of the set of runs, its size, low bytes of the signature, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, readings = Hasher(), known.value
        for batch in batches:
            ids, classes, sizes, sigs = [], [], [], []
            for i, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i is None or forms.blank(t):
                    continue
                runs = hasher.runs(forms.form(t, readings, forms.plain(f)), k)
                ids.append(i)
                classes.append(_class(runs))
                sizes.append(len(runs))
                sigs.append(signature(runs))
            every = np.stack(sigs) if sigs else np.empty((0, HASHES), np.uint32)
            bands = every.reshape(len(ids), HASHES // rows, rows).astype(np.uint64)
            keys = np.tile(np.arange(HASHES // rows, dtype=np.uint64), (len(ids), 1))
            with np.errstate(over="ignore"):
                for r in range(rows):
                    keys = (keys ^ bands[:, :, r]) * np.uint64(_SEED)
                    keys ^= keys >> np.uint64(31)
            ends = np.arange(len(ids) + 1, dtype=np.int32) * (HASHES // rows)
            low = every.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()), pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()), pa.array([x.tobytes() for x in low], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel())),
                ],
                names=["id", "class", "size", "sig", "bands"],
            )

    return run


def _payload(known, k: int):
    """id, text, fixes -> class, runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, readings = Hasher(), known.value
        for batch in batches:
            sets = [hasher.runs(forms.form(t, readings, forms.plain(f)), k) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            rows = [[_class(r) for r in sets], [r.tobytes() for r in sets]]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.binary()) for r in rows], names=["class", "runs"])

    return run


def _class(runs: np.ndarray) -> bytes:
    """The name of all records with this set of runs."""
    return hashlib.blake2b(runs.tobytes(), digest_size=16).digest()


def _cut(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb, na, nb = batch.columns
            na, nb = na.to_pylist(), nb.to_pylist()
            sig = lambda c, i: np.frombuffer(c[i].as_buffer(), np.uint8)
            keep = pa.array([likely(sig(sa, i), sig(sb, i), na[i], nb[i], threshold) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ra, rb = batch.columns
            of = lambda c, i: np.frombuffer(c[i].as_buffer(), np.uint64)
            keep = pa.array([verified(of(ra, i), of(rb, i), threshold) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def _prefixes(df: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of classes that share one of their rarest runs, of those in crowded buckets.

    Sets that reach the threshold share a run within the first n - ceil(t n) + 1 of each
    set, runs being ordered by how many sets hold them (ties by hash); after the first
    shared run enough must be left of both sets to reach it. Runs that very many sets hold
    come last, and a join partition that they fill is split by adaptive execution.
    """
    runs = df.select(F.col("class").alias("id"), F.explode("runs").alias("run"))
    often = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = (
        runs.join(often, "run", "left")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "run"))).alias("all"))
    )
    size = F.size("all")
    first = ordered.select(
        "id", size.alias("size"),
        F.posexplode(F.slice("all", 1, (size - F.ceil(size * F.lit(threshold) - 1e-9) + 1).cast("int"))).alias("place", "at"),
    ).where("at.n > 1").select("id", "size", (F.col("size") - F.col("place")).alias("left"), F.col("at.run").alias("run"))
    other = first.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("left").alias("left_b"), "run")
    need = (F.col("size") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-6
    near = (F.col("size") * 1.0 >= F.col("size_b") * threshold) & (F.col("size_b") * 1.0 >= F.col("size") * threshold) & (F.least("left", "left_b") >= need)
    return first.withColumnRenamed("id", "a").join(other, "run").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _as_runs(payload: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))], names=["class", "runs"])

    return payload.select("class", "runs").mapInArrow(run, "class binary, runs array<long>")


class NearCopies:
    """What one pass over a corpus found.

    ``members``: id and class; ``links``: pairs a < b of classes that reach the threshold.
    """

    def __init__(self, members: DataFrame, links: DataFrame, stage: Stage):
        self.members, self.links, self.stage = members, links, stage


def _beside(df: DataFrame, few: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of ``df`` whose key is in the written table ``few``, which goes to every worker if it is small."""
    return df.join(F.broadcast(few) if few.count() <= most else few, key, "left_semi")


def near_copies(df: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = RUN, rows: int = ROWS, crowd: int = CROWD, max_ids: int = MAX_BROADCAST_IDS, **kw) -> NearCopies:
    """Classes of records with equal sets of runs, and all links between classes."""
    spark = df.sparkSession
    stage = Stage(spark, "nearcopies")
    source, known = forms.prepared(df, id, text, **kw)
    source = source.withColumn("id", F.col("id").cast("string"))
    marks = stage.keep(source.mapInArrow(_marks(known, k, rows), "id string, class binary, size int, sig binary, bands array<long>"), "marks")

    # Copies have the same runs and bands, so bands are compared by class, not by record.
    bands = marks.select("class", F.hash("class").alias("mark"), F.explode(F.array_distinct("bands")).alias("band"))
    several = bands.groupBy("band").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low != high").select("band")
    several = stage.keep(several, "several")
    shared = stage.keep(_beside(bands.drop("mark"), several, "band", max_ids).distinct(), "shared")
    sizes = shared.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    crowded = stage.keep(shared.join(sizes.where(F.col("n") > crowd), "band", "left_semi").select("class").distinct(), "crowded")
    thin = shared.join(sizes.where(F.col("n").between(2, crowd)), "band", "left_semi")
    pairs = thin.select("band", F.col("class").alias("a")).join(thin.select("band", F.col("class").alias("b")), "band").where("a < b").select("a", "b").distinct()
    pairs = stage.keep(pairs, "banded")

    # Signatures are compared first, a byte a value; only what they leave is looked up in the texts.
    ends = lambda of: of.select(F.col("a").alias("class")).union(of.select("b")).distinct()
    sigs = _beside(marks.select("class", "sig", "size"), stage.keep(ends(pairs), "ends"), "class", max_ids).dropDuplicates(["class"])
    met = pairs.join(sigs.toDF("a", "sig_a", "size_a"), "a").join(sigs.toDF("b", "sig_b", "size_b"), "b")
    pairs = stage.keep(met.select("a", "b", "sig_a", "sig_b", "size_a", "size_b").mapInArrow(_cut(threshold), "a binary, b binary"), "likely")
    meant = stage.keep(ends(pairs).union(crowded).distinct(), "meant")
    reps = stage.keep(_beside(marks.select("class", "id"), meant, "class", max_ids).groupBy("class").agg(F.min("id").alias("id")), "reps")
    named = stage.keep(_beside(source.where(F.col("text").isNotNull()), reps.select("id"), "id", max_ids).mapInArrow(_payload(known, k), "class binary, runs binary"), "payload")
    payload = named.dropDuplicates(["class"])
    if not crowded.isEmpty():
        dense = _as_runs(payload.join(crowded, "class", "left_semi"))
        pairs = stage.keep(pairs.union(_prefixes(dense, threshold)).distinct(), "pairs")
    met = pairs.join(payload.toDF("a", "runs_a"), "a").join(payload.toDF("b", "runs_b"), "b").select("a", "b", "runs_a", "runs_b")
    links = stage.keep(met.mapInArrow(_verify(threshold), "a binary, b binary"), "links")
    members = marks.select("id", "class").distinct()
    return NearCopies(members, links, stage)


def near_copy_pairs(df: DataFrame, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Every pair ``<id>_a < <id>_b`` of records that reach the threshold, copies included.

    The pairs are the result asked for, so a class of n copies gives n (n - 1) / 2 of them.
    """
    found = near_copies(df, id, text, **kw)
    held = found.members
    a = held.select(F.col("id").alias("x"), F.col("class").alias("a"))
    b = held.select(F.col("id").alias("y"), F.col("class").alias("b"))
    across = found.links.join(a, "a").join(b, "b").select(F.least("x", "y").alias(f"{id}_a"), F.greatest("x", "y").alias(f"{id}_b"))
    several = held.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class")
    copies = held.join(several, "class", "left_semi")
    within = copies.select(F.col("id").alias(f"{id}_a"), "class").join(copies.select(F.col("id").alias(f"{id}_b"), "class"), "class").where(F.col(f"{id}_a") < F.col(f"{id}_b")).drop("class")
    return across.union(within)


def near_copy_groups(df: DataFrame, id: str = "doc_id", text: str = "text", rounds: int = 64, **kw) -> DataFrame:
    """``id``, ``class_id``, ``n_links`` of its class, ``group_id``: one row per record with runs.

    A group is a connected set of classes, named by its least id. Least names travel along
    links and then along names already reached; each round is written to the shared folder,
    and groups that ``rounds`` do not settle end in an error.
    """
    found = near_copies(df, id, text, **kw)
    links, stage = found.links, found.stage
    both = stage.keep(links.union(links.select("b", "a")).toDF("a", "b"), "both")
    name = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("name"))
    name = stage.keep(name, "name0")
    for turn in range(1, rounds + 1):
        beside = both.join(name.toDF("b", "name"), "b").groupBy("a").agg(F.min("name").alias("near"))
        nearer = name.join(beside, "a", "left").select("a", F.least("name", F.coalesce("near", "name")).alias("name"), F.col("name").alias("was"))
        jump = nearer.select(F.col("a").alias("name"), F.col("name").alias("far"))
        moved = nearer.join(jump, "name", "left").select("a", F.least("name", F.coalesce("far", "name")).alias("name"), "was")
        moved = stage.keep(moved, f"name{turn}")
        stage.drop(f"name{turn - 1}")
        name = moved.select("a", "name")
        if moved.where("name != was").isEmpty():
            break
    else:
        raise RuntimeError(f"groups not settled after {rounds} rounds; raise rounds")
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    known = name.join(degree, "a").withColumnRenamed("a", "class")
    least = found.members.groupBy("class").agg(F.min("id").alias("class_id"))
    named = least.join(known, "class", "left").withColumn("name", F.coalesce("name", "class"))
    group = named.groupBy("name").agg(F.min("class_id").alias("group_id"))
    classes = named.join(group, "name").select("class", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_id")
    return found.members.join(classes, "class").select(F.col("id").alias(id), "class_id", "n_links", "group_id")
