"""Hashes, contamination and duplicates: queries over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.catalog.texts import _canon, _D, _grams, _words
from lodeworks.functions import hashing as H
from lodeworks.functions import text as T
from lodeworks.operators import dedup
from lodeworks.registry import query

_SHORT = lambda x: f"(('0x' || substr(md5({x}), 1, 8))::BIGINT % {H.PRIME})"
_LONG = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
_SETS = f"sets AS (SELECT doc_id, list_sort(list_distinct(list_transform({_grams('w', 5)}, lambda g: {_SHORT('g')}))) AS h FROM (SELECT doc_id, {_words(_D)} AS w FROM documents))"
_COEF = "[" + ", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in H.coefficients()) + "]"
_SIGS = f"sigs AS (SELECT doc_id, list_transform({_COEF}, lambda c: coalesce(list_min(list_transform(h, lambda x: (c.a * x + c.b) % {H.PRIME})), {H.PRIME})) AS sig FROM sets)"
_BANDS = "bands AS (SELECT doc_id, b, md5(array_to_string(sig[b * 4 + 1 : b * 4 + 4], ',')) AS key FROM sigs, range(32) r(b))"


def _fps(table: str, id: str, n: int) -> str:
    return f"(SELECT DISTINCT {id}, {_LONG('g')} AS fp FROM (SELECT {id}, unnest({_grams('w', n)}) AS g FROM (SELECT {id}, {_words(_canon(_D))} AS w FROM {table})))"


@query("h01_shingle_hashes", "documents", sql=f"WITH {_SETS} SELECT doc_id, len(h) AS n, coalesce(list_min(h), -1) AS least, coalesce(list_sum(h), 0)::BIGINT AS total FROM sets")
def shingle_hashes(d: DataFrame) -> DataFrame:
    made = dedup.shingle_hashes(d, "doc_id")
    return made.select("doc_id", F.size("hashes").cast("long").alias("n"), F.coalesce(F.array_min("hashes"), F.lit(-1)).alias("least"), F.aggregate("hashes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("h01_exact_hashes", "documents")
def exact_hashes(d: DataFrame) -> DataFrame:
    return dedup.exact_hashes(d, "doc_id")


@query("h02_minhash_signature", "documents", sql=f"WITH {_SETS}, {_SIGS} SELECT doc_id, array_to_string(sig, ',') AS sig FROM sigs")
def minhash(d: DataFrame) -> DataFrame:
    return dedup.signed(d, "doc_id").select("doc_id", F.array_join(F.transform("sig", lambda v: v.cast("string")), ",").alias("sig"))


@query("h03_band_keys", "documents", sql=f"WITH {_SETS}, {_SIGS}, {_BANDS} SELECT doc_id, b AS band, key FROM bands")
def band_keys(d: DataFrame) -> DataFrame:
    return dedup.banded(d, "doc_id").select("doc_id", "band", "key")


@query("j01_lsh_candidates", "documents", sql=f"""WITH {_SETS}, {_SIGS}, {_BANDS}
SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y USING (b, key) WHERE x.doc_id < y.doc_id""")
def lsh_candidates(d: DataFrame) -> DataFrame:
    return dedup.lsh_pairs(d, "doc_id")


@query("h04_signature_agreement", "documents", sql=f"""WITH {_SETS}, {_SIGS}, {_BANDS},
pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y USING (b, key) WHERE x.doc_id < y.doc_id)
SELECT a, pairs.b AS b FROM pairs JOIN sigs s ON s.doc_id = a JOIN sigs t ON t.doc_id = pairs.b WHERE list_sum(list_transform(range(1, 129), lambda i: CASE WHEN s.sig[i] = t.sig[i] THEN 1 ELSE 0 END)) >= 103""")
def agreement(d: DataFrame) -> DataFrame:
    return dedup.minhash_links(d, "doc_id", 103)


@query("d01_minhash_dedup", "documents")
def minhash_dedup(d: DataFrame) -> DataFrame:
    return dedup.minhash_dropped(d, "doc_id", 103).select("doc_id", F.lit(True).alias("is_dup"))


_PAIRS = f"""{_SETS.replace("FROM documents", "FROM run_pipeline").replace(_SHORT("g"), _LONG("g"))}, reps AS (SELECT min(doc_id) AS rep, h FROM sets WHERE len(h) > 0 GROUP BY h), x AS (SELECT rep, unnest(h) AS g FROM reps),
met AS (SELECT p.rep AS a, q.rep AS b, count(*) AS common FROM x p JOIN x q USING (g) WHERE p.rep < q.rep GROUP BY ALL),
pairs AS (SELECT a, b, common, len(s.h) + len(t.h) - common AS total FROM met JOIN reps s ON s.rep = a JOIN reps t ON t.rep = b)"""


@query("d02_near_dup_pairs", "run_pipeline", sql=f"WITH {_PAIRS} SELECT a, b, common, total FROM pairs WHERE common >= 0.8 * total - 1e-9")
def near_dup_pairs(d: DataFrame) -> DataFrame:
    return dedup.jaccard_pairs(d, "doc_id").select("a", "b", F.col("common").cast("long").alias("common"), F.col("total").cast("long").alias("total"))


@query("d02_classes", "documents", sql=f"WITH {_SETS} SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM sets WHERE len(h) > 0")
def shingle_classes(d: DataFrame) -> DataFrame:
    return dedup.classes(d, "doc_id")


@query("d02_near_dup_kept", "run_pipeline")
def near_dup_kept(d: DataFrame) -> DataFrame:
    return dedup.greedy(dedup.jaccard_pairs(d, "doc_id").select("a", "b"))


@query("h05_jaccard_histogram", "run_pipeline", sql=f"WITH {_PAIRS} SELECT (10 * common) // total AS tenth, count(*) AS n FROM pairs WHERE common >= 0.5 * total - 1e-9 GROUP BY 1")
def jaccard_histogram(d: DataFrame) -> DataFrame:
    found = dedup.jaccard_pairs(d, "doc_id", threshold=0.5)
    return found.groupBy(F.floor(10 * F.col("common") / F.col("total")).alias("tenth")).agg(F.count(F.lit(1)).alias("n"))


@query("d03_exact_duplicates", "documents", sql=f"SELECT sha256({_D}) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def exact_duplicates(d: DataFrame) -> DataFrame:
    return dedup.exact_duplicates(d)


@query("d04_global_vs_local", "documents", sql=f"SELECT count(*) - count(DISTINCT sha256({_D})) AS global_dups, count(*) - count(DISTINCT coalesce(source, 'none') || '|' || sha256({_D})) AS local_dups FROM documents")
def global_vs_local(d: DataFrame) -> DataFrame:
    every = dedup.exact_duplicates(d).agg(F.sum(F.col("n") - 1).alias("global_dups"))
    local = dedup.exact_duplicates(d, by=F.coalesce("source", F.lit("none"))).agg(F.sum(F.col("n") - 1).alias("local_dups"))
    return every.join(F.broadcast(local))


@query("h06_ngram_fingerprints", "documents", sql=f"SELECT doc_id, count(*) AS n_distinct FROM {_fps('documents', 'doc_id', 8)} GROUP BY doc_id")
def ngram_fingerprints(d: DataFrame) -> DataFrame:
    return dedup.fingerprints(d, "doc_id", 8).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_distinct"))


@query("h07_eval_fingerprints", "benchmark", sql=f"SELECT count(DISTINCT fp) AS n, count(*) AS with_repeats FROM {_fps('benchmark', 'item_id', 13)}")
def eval_fingerprints(b: DataFrame) -> DataFrame:
    per = dedup.fingerprints(b, "item_id", 13).groupBy("fp").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("with_repeats"))


@query("j02_contaminated_docs", "run_pipeline", "benchmark", sql=f"SELECT DISTINCT doc_id FROM {_fps('run_pipeline', 'doc_id', 13)} SEMI JOIN {_fps('benchmark', 'item_id', 13)} USING (fp)")
def contaminated(d: DataFrame, b: DataFrame) -> DataFrame:
    return dedup.contaminated(d, b, 13)


@query("j02_decontaminated", "run_pipeline", "benchmark", sql=f"SELECT DISTINCT doc_id FROM run_pipeline WHERE doc_id NOT IN (SELECT doc_id FROM {_fps('run_pipeline', 'doc_id', 13)} SEMI JOIN {_fps('benchmark', 'item_id', 13)} USING (fp))")
def decontaminated(d: DataFrame, b: DataFrame) -> DataFrame:
    return d.select("doc_id").distinct().join(dedup.contaminated(d, b, 13), "doc_id", "left_anti")


@query("j03_overlap_pct", "run_pipeline", "benchmark", sql=f"SELECT doc_id, count(hit) AS matched, count(*) AS total, count(hit) * 10000 // count(*) AS per_10k FROM {_fps('run_pipeline', 'doc_id', 8)} LEFT JOIN (SELECT DISTINCT fp, 1 AS hit FROM {_fps('benchmark', 'item_id', 8)}) USING (fp) GROUP BY doc_id")
def overlap_pct(d: DataFrame, b: DataFrame) -> DataFrame:
    return dedup.overlap(d, b, 8).withColumn("per_10k", F.floor(F.col("matched") * 10000 / F.col("total")))


@query("h08_corpus_hash", "documents", sql=f"SELECT sha256(string_agg(h, '' ORDER BY block)) AS digest FROM (SELECT doc_id // 10000 AS block, sha256(string_agg(sha256({_D}), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1)")
def corpus_hash(d: DataFrame) -> DataFrame:
    """One digest of all texts in order of their ids: texts, then blocks of 10,000 ids, then the blocks' digests."""

    def joined(order: str, digest: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda x: x[digest]), ""), 256)

    texts = d.select("doc_id", F.floor(F.col("doc_id") / 10_000).alias("block"), F.sha2(T.text_of("text"), 256).alias("h"))
    blocks = texts.groupBy("block").agg(joined("doc_id", "h").alias("h"))
    return blocks.agg(joined("block", "h").alias("digest"))


_IDS = lambda x: f"list_transform({x}, lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT)"


@query("h10_shard_hash", "benchmark", sql=f"SELECT item_id, sha256(unhex(array_to_string(list_transform({_IDS(_words(_D))}, lambda i: lpad(printf('%X', i), 8, '0')), ''))) AS digest FROM benchmark")
def shard_hash(b: DataFrame) -> DataFrame:
    ids = F.transform(T.words(T.text_of("text")), lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long"))
    return b.select("item_id", H.ids_hash(ids).alias("digest"))


@query("h12_loss_mask_hash", "documents", sql=f"SELECT doc_id, sha256(unhex(array_to_string(list_transform({_words(_D)}, lambda w: CASE WHEN length(w) % 2 = 0 THEN '01' ELSE '00' END), ''))) AS digest FROM documents")
def loss_mask_hash(d: DataFrame) -> DataFrame:
    return d.select("doc_id", H.mask_hash(F.transform(T.words(T.text_of("text")), lambda w: (F.length(w) % 2 == 0).cast("int"))).alias("digest"))


@query("h13_state_hash", "ledger", sql="SELECT ledger_offset, sha256('{\"branch\": \"' || run_branch_id || '\", \"offset\": ' || ledger_offset || '}') AS digest FROM ledger")
def state_hash(e: DataFrame) -> DataFrame:
    return e.select("ledger_offset", F.sha2(F.concat(F.lit('{"branch": "'), "run_branch_id", F.lit('", "offset": '), F.col("ledger_offset").cast("string"), F.lit("}")), 256).alias("digest"))


@query("h14_unit_interval", "manifest", sql="SELECT DISTINCT shard_id, ((('0x' || substr(sha256(shard_id), 1, 8))::BIGINT * 10000) // 4294967296) AS score FROM manifest")
def unit_interval(m: DataFrame) -> DataFrame:
    return m.select("shard_id").distinct().select("shard_id", H.unit_interval(F.col("shard_id")).alias("score"))


@query("d05_token_collisions", "documents", sql=f"WITH t AS (SELECT DISTINCT unnest({_words(_D)}) AS token FROM documents), k AS (SELECT token, R, CASE WHEN octet_length(encode(token)) <= R THEN token ELSE substr(token, 1, R) END AS key FROM t, (VALUES (4), (8), (16)) r(R)) SELECT R AS width, count(*) AS n, (sum(CASE WHEN c > 1 THEN 1 ELSE 0 END))::BIGINT AS n_collided FROM (SELECT *, count(*) OVER (PARTITION BY R, key) AS c FROM k) GROUP BY R")
def token_collisions(d: DataFrame) -> DataFrame:
    tokens = d.select(F.explode(T.words(T.text_of("text"))).alias("token")).distinct()
    keyed = tokens.select("token", F.explode(F.array(*map(F.lit, (4, 8, 16)))).alias("width"))
    keyed = keyed.withColumn("key", F.concat_ws("|", "width", F.when(F.octet_length("token") <= F.col("width"), F.col("token")).otherwise(F.substring("token", F.lit(1), F.col("width")))))
    return dedup.collided(keyed, "key").groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("collides").cast("long")).alias("n_collided"))
