"""Fingerprints, contamination, exact and near duplicates, and greedy first-seen removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import hashing as H
from lodeworks.functions import text as T
from lodeworks.runtime import Stage

#: Fingerprints up to which the evaluation side goes to every worker.
MAX_BROADCAST = 5_000_000


def beside(df: DataFrame, few: DataFrame, key: str, how: str, most: int = MAX_BROADCAST) -> DataFrame:
    """A join whose right side is broadcast if a count finds it small, shuffled otherwise."""
    return df.join(F.broadcast(few) if few.count() <= most else few, key, how)


class _Numbers(dict):
    """64-bit numbers of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        made = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return made


def gram_sets(d: DataFrame, id: str, n: int, text: str = "text", lower: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, the columns of ``keep``, and ``hashes``: sorted distinct 64-bit hashes of the runs of n words.

    A shorter text is one run, one without words none. In Arrow batches: words are numbered
    once per worker and runs are hashed by the array, many times faster than by expressions.
    """
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in (id, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Numbers()
        for batch in batches:
            sets = []
            for t in batch.column(len(batch.columns) - 1).to_pylist():
                words = ((t or "").lower() if lower else t or "").split()
                if len(known) > 500_000:
                    known.clear()
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                size = min(n, len(h))
                made = np.zeros(len(h) - size + 1 if len(h) else 0, np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(size):
                        made ^= h[i : i + len(made)]
                        made *= np.uint64(0x9E3779B97F4A7C15)
                        made ^= made >> np.uint64(29)
                made = made.view(np.int64)
                made.sort()
                first = np.ones(len(made), bool)
                np.not_equal(made[1:], made[:-1], out=first[1:])
                sets.append(made[first])
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), flat)], names=[id, *keep, "hashes"])

    return d.select(id, *keep, F.col(text).cast("string").alias("_said")).mapInArrow(run, f"{kinds}, hashes array<long>")


def fingerprints(d: DataFrame, id: str, n: int, text: str = "text") -> DataFrame:
    """``id`` and ``fp``: distinct fingerprints of the runs of n words of the canonical text."""
    return gram_sets(d, id, n, text, lower=True).select(id, F.explode("hashes").alias("fp"))


def overlap(d: DataFrame, items: DataFrame, n: int, id: str = "doc_id") -> DataFrame:
    """``id``, ``matched`` and ``total``: distinct fingerprints shared with any item, and all.

    Fingerprints are counted per text before anything is shuffled. A record delivered again
    with the same text counts once; one that has several texts is worked out from the
    distinct fingerprints of all of them.
    """
    known = fingerprints(items, "item_id", n).select("fp").distinct().withColumn("hit", F.lit(1))
    rows = gram_sets(d.select(id, "text", F.xxhash64("text").alias("_text")), id, n, lower=True, keep=("_text",))
    spread = rows.select(id, "_text", F.size("hashes").alias("_size"), F.posexplode("hashes").alias("_at", "fp"))
    per = beside(spread, known, "fp", "left").groupBy(id, "_text").agg(F.count("hit").alias("hits"), F.count_if(F.col("_at") == 0).alias("times"), F.max("_size").alias("total"))
    per = Stage(d.sparkSession, "overlap").keep(per.select(id, (F.col("hits") / F.col("times")).cast("long").alias("matched"), F.col("total").cast("long").alias("total")), "per")
    several = per.groupBy(id).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id)
    if several.isEmpty():
        return per
    others = beside(fingerprints(d.join(several, id, "left_semi"), id, n).distinct(), known, "fp", "left")
    return per.join(several, id, "left_anti").union(others.groupBy(id).agg(F.count("hit").alias("matched"), F.count(F.lit(1)).alias("total")))


def contaminated(d: DataFrame, items: DataFrame, n: int, id: str = "doc_id") -> DataFrame:
    """Ids of documents that share a fingerprint with any item."""
    known = fingerprints(items, "item_id", n).select("fp").distinct()
    return beside(fingerprints(d, id, n), known, "fp", "left_semi").select(id).distinct()


def shingle_hashes(d: DataFrame, id: str, k: int = 5, text: str = "text") -> DataFrame:
    """``id`` and ``hashes``, the distinct portable hashes of the runs of k words."""
    return d.select(id, F.array_distinct(F.transform(T.grams(T.words(T.text_of(text)), k), H.short_hash)).alias("hashes"))


def exact_hashes(d: DataFrame, id: str, k: int = 5, text: str = "text") -> DataFrame:
    """``id`` and ``hashes``, sorted: 32-bit blake2b of each distinct run of k words modulo the prime, in Arrow batches."""
    kind = d.schema[id].dataType.simpleString()

    def of(text: str | None) -> list[int]:
        words = (text or "").split()
        grams = {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
        return sorted(int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % H.PRIME for g in grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["id", "hashes"])

    return d.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, hashes array<long>").withColumnRenamed("id", id)


def shingle_sets(d: DataFrame, id: str, k: int = 5, text: str = "text") -> DataFrame:
    """``id`` and ``hashes``, the sorted distinct 64-bit hashes of the runs of k words, of texts that have any."""
    return gram_sets(d, id, k, text).where(F.size("hashes") > 0)


def signed(d: DataFrame, id: str, k: int = 5, text: str = "text") -> DataFrame:
    """``id`` and ``sig``: the MinHash signature over the hashes of ``shingle_hashes``, in Arrow batches.

    A text without words has the prime throughout, as ``hashing.signature`` gives it.
    """
    kind = d.schema[id].dataType.simpleString()
    a, b = (np.array(x, np.int64)[:, None] for x in zip(*H.coefficients(), strict=True))

    def of(text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.full(len(a), H.PRIME, np.int64)
        grams = {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
        h = np.fromiter((int.from_bytes(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[:4], "big") for g in grams), np.int64, len(grams)) % H.PRIME
        best = np.full((len(a), 1), H.PRIME, np.int64)
        for at in range(0, len(h), 256):  # a block stays in the processor's cache
            best = np.minimum(best, ((a * h[at : at + 256] + b) % H.PRIME).min(axis=1, keepdims=True))
        return best.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [of(t) for t in batch.column(1).to_pylist()]
            ends = pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * len(a))
            flat = pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["id", "sig"])

    return d.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, sig array<long>").withColumnRenamed("id", id)


def banded(d: DataFrame, id: str, bands: int = H.BANDS) -> DataFrame:
    """``id``, ``sig``, ``band``, ``key``: one row per band of the MinHash signature."""
    return signed(d, id).select(id, "sig", F.posexplode(H.band_keys(F.col("sig"), bands)).alias("band", "key"))


def signature_classes(d: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    """``id`` and ``rep`` of every document, and ``rep``, ``n`` and ``sig`` of every class of equal signatures, named by its least id."""
    stage = Stage(d.sparkSession, "classes")
    sigs = stage.keep(signed(d, id), "sigs")
    of = sigs.select(id, F.md5(F.array_join(F.transform("sig", lambda v: v.cast("string")), ",")).alias("of"))
    sizes = of.groupBy("of").agg(F.min(id).alias("rep"), F.count(F.lit(1)).alias("n"))
    members = stage.keep(of.join(sizes, "of").select(id, "rep", "n"), "members")
    first = members.where(F.col(id) == F.col("rep")).select("rep", "n").distinct()
    return members.select(id, "rep"), first.join(sigs.select(F.col(id).alias("rep"), "sig"), "rep")


def shared_buckets(reps: DataFrame) -> DataFrame:
    """``rep``, ``band``, ``key`` and ``k``, the classes in it, of every bucket of more than one class."""
    keys = reps.select("rep", F.posexplode(H.band_keys(F.col("sig"))).alias("band", "key")).withColumn("key", F.unhex("key"))
    return keys.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("band", "key"))).where("k > 1")


def candidates(rows: DataFrame, id: str) -> DataFrame:
    """All pairs a < b that share a bucket."""
    side = lambda name: rows.select("band", "key", F.col(id).alias(name))
    return side("a").join(side("b"), ["band", "key"]).where("a < b").select("a", "b").distinct()


def spread(pairs: DataFrame, members: DataFrame, reps: DataFrame, id: str, part: int = 1_000) -> DataFrame:
    """Pairs a < b of documents: those of paired classes, and those within each class.

    The work on a large class is cut into parts of about ``part`` documents; the pairs do not depend on it.
    """
    parts = reps.select(F.col("rep").alias("b"), F.ceil(F.col("n") / part).alias("parts"))
    classes_ = pairs.select("a", "b").union(reps.where("n > 1").select("rep", "rep")).join(parts, "b")
    left = classes_.join(members.select(F.col("rep").alias("a"), F.col(id).alias("x")), "a").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")))
    right = members.select(F.col("rep").alias("b"), F.col(id).alias("y")).join(parts, "b").select("b", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = left.join(right, ["b", "part"]).where((F.col("a") != F.col("b")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def lsh_pairs(d: DataFrame, id: str) -> DataFrame:
    """All pairs a < b of documents that share a band bucket; classes of equal signatures are banded once."""
    members, reps = signature_classes(d, id)
    return spread(candidates(shared_buckets(reps), "rep"), members, reps, id)


def near_classes(reps: DataFrame, least: int) -> DataFrame:
    """All pairs a < b of classes that share a bucket and agree in at least ``least`` signature values.

    m values that differ spoil at most m bands, so of any m + 1 bands of such a pair one agrees:
    the m + 1 rarest buckets of each class (by one order for all) hold every pair, and buckets
    that are crowded are mostly left out. If m + 1 exceeds the bands, all are compared.
    """
    ranked = shared_buckets(reps).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("k", "band", "key"))).alias("all"))
    most = F.lit(H.HASHES - least + 1 - H.BANDS) + F.size("all")  # its buckets of one class come before these
    rare = ranked.where(most > 0).select("rep", F.explode(F.slice("all", F.lit(1), most)).alias("at")).select("rep", "at.band", "at.key")
    met = Stage(reps.sparkSession, "met").keep(candidates(rare, "rep"), "pairs")
    ends = met.select(F.col("a").alias("rep")).union(met.select("b")).distinct()
    sigs = beside(reps.select("rep", "sig"), ends, "rep", "left_semi")
    both = met.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
    return both.where(H.agreement(F.col("sig_a"), F.col("sig_b")) >= least).select("a", "b")


def minhash_links(d: DataFrame, id: str, least: int) -> DataFrame:
    """All pairs a < b that share a bucket and whose signatures agree in at least ``least`` values."""
    members, reps = signature_classes(d, id)
    return spread(near_classes(reps, least), members, reps, id)


def minhash_dropped(d: DataFrame, id: str, least: int) -> DataFrame:
    """Ids that first-seen removal over ``minhash_links`` drops.

    Documents of one class have the same links, so all but its first are dropped and keep
    nobody out; the greedy rounds run over the first ones alone.
    """
    members, reps = signature_classes(d, id)
    first = greedy(near_classes(reps, least)).select(F.col("node").alias(id))
    return members.where(F.col(id) != F.col("rep")).select(id).union(first).distinct()


def jaccard_pairs(d: DataFrame, id: str, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``a``, ``b``, ``common``, ``total`` of all pairs of distinct texts that reach the threshold, exactly.

    Texts with equal sets form one class, named by its least id; classes are compared by
    prefix filtering: sets that reach the threshold share one of their rarest shingles, and
    enough is left of both from there on. A join partition that one shingle fills is split
    by adaptive execution.
    """
    stage = Stage(d.sparkSession, "jaccard")
    reps = stage.keep(shingle_sets(d, id, k).groupBy("hashes").agg(F.min(id).alias("rep")).select("rep", "hashes"), "reps")
    rows = reps.select("rep", F.explode("hashes").alias("h"))
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A run that one set alone has cannot be shared: only the others are put in order, after as many places as those take.
    ordered = rows.join(often, "h").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("shared"))
    sized = ordered.join(reps.select("rep", F.size("hashes").alias("size")), "rep")
    size, alone = F.col("size"), F.col("size") - F.size("shared")
    prefix = size - F.ceil(size * threshold - 1e-9) + 1 - alone
    first = sized.where(prefix > 0).select("rep", "size", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), prefix.cast("int"))).alias("at", "run")).select("rep", "size", (F.col("size") - F.col("alone") - F.col("at")).alias("left"), F.col("run.h").alias("h"))
    left = first.toDF("a", "sa", "la", "h")
    right = first.toDF("b", "sb", "lb", "h")
    need = (F.col("sa") + F.col("sb")) * (threshold / (1 + threshold)) - 1e-6  # common runs that the threshold takes
    near = (F.col("sa") >= F.col("sb") * threshold) & (F.col("sb") >= F.col("sa") * threshold) & (F.least("la", "lb") >= need)
    pairs = stage.keep(left.join(right, "h").where("a < b").where(near).select("a", "b").distinct(), "pairs")
    both = pairs.join(reps.toDF("a", "ha"), "a").join(reps.toDF("b", "hb"), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    counted = both.select("a", "b", common.alias("common"), (F.size("ha") + F.size("hb")).alias("sum"))
    return counted.select("a", "b", "common", (F.col("sum") - F.col("common")).alias("total")).where(F.col("common") >= threshold * F.col("total") - 1e-9)


def classes(d: DataFrame, id: str, k: int = 5) -> DataFrame:
    """``id`` and ``rep``, the least id with the same set of shingles."""
    sets = shingle_sets(d, id, k)
    return sets.join(sets.groupBy("hashes").agg(F.min(id).alias("rep")), "hashes").select(id, "rep")


def greedy(links: DataFrame, rounds: int = 64) -> DataFrame:
    """First-seen removal over links a < b: ``node``, ``kept_by`` (the least kept neighbour), for each dropped node.

    A node is dropped iff an earlier node it is linked to is kept. Each round decides the
    nodes all of whose earlier neighbours are decided; rounds are written to the shared
    folder, and a chain longer than ``rounds`` ends in an error, never in a wrong answer.
    """
    stage = Stage(links.sparkSession, "greedy")
    links = stage.keep(links.select("a", "b").distinct(), "links")
    state = stage.keep(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("state", F.lit(0)), "state0")
    for turn in range(1, rounds + 1):
        seen = links.join(state.select(F.col("node").alias("a"), F.col("state").alias("sa")), "a")
        below = seen.groupBy(F.col("b").alias("node")).agg(F.max((F.col("sa") == 1).cast("int")).alias("kept"), F.max((F.col("sa") == 0).cast("int")).alias("open"))
        moved = state.join(below, "node", "left").select(
            "node",
            F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("kept", F.lit(0)) == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0).alias("state"),
        )
        state = stage.keep(moved, f"state{turn}")
        stage.drop(f"state{turn - 1}")
        if state.where("state = 0").isEmpty():
            break
    else:
        raise RuntimeError(f"undecided after {rounds} rounds; raise rounds")
    kept = state.where("state = 1").select(F.col("node").alias("a"))
    return links.join(kept, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("kept_by"))


def exact_duplicates(d: DataFrame, id: str = "doc_id", by: Column | None = None) -> DataFrame:
    """``digest``, ``n`` and ``first_id`` of every text, an optional key keeping groups apart."""
    key = F.sha2(T.text_of("text"), 256)
    return d.groupBy((key if by is None else F.concat_ws("|", by, key)).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(id).alias("first_id"))


def collided(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``collides``: whether another row has the same key."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(sizes, key).withColumn("collides", F.col("_n") > 1).drop("_n")
