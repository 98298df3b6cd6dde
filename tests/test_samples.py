"""Samples, replay, resume, decisions, packing, codes, kernels: against plain versions and tampered rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.catalog import codes, execution, formulas, kernels, ledger
from lodeworks.catalog import samples as queries
from lodeworks.operators import cleaning, dedup
from lodeworks.operators import samples as S

DOCS = "doc_id long, text string, lane string, id string, tokens string, bin string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "general", "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def plain_stream(text):
    out = []
    for line in (text or "").split("\n"):
        m = re.match(r"(user|plan|tool_call|observation|response): (.*)$", line)
        said, bears = (m[2], m[1] in S.LOSS_ROLES) if m else (line, True)
        out += [(int(hashlib.md5(w.encode()).hexdigest()[:6], 16) + 4, int(bears)) for w in re.findall(r"\w+|[^\w\s]", said.lower())]
    return [*out, (S.EOS, 0)] if out else []


def plain_samples(texts, size):
    flat = [(i, p, t, m) for i, text in enumerate(texts) for p, (t, m) in enumerate(plain_stream(text))]
    out = []
    for at in range(0, len(flat), size):
        part = flat[at : at + size]
        ids = list(dict.fromkeys(i for i, *_ in part))
        first = {i: min(p for j, p, *_ in part if j == i) for i in ids}
        pad = size - len(part)
        out.append({
            "shard_ids": [str(i) for i in ids], "tokens": [t for *_, t, _ in part] + [S.PAD] * pad, "loss_mask": [m for *_, m in part] + [0] * pad,
            "segment_ids": [ids.index(i) for i, *_ in part] + [len(ids)] * pad, "position_ids": [p - first[i] for i, p, *_ in part] + [0] * pad,
        })
    return out


TEXTS = ["user: hi there\nplan: go to the market now\nobservation: it rains", None, "", "plain words stand here", "response: done , then done again and again\nuser: ok", "x " * 50, " \n "]


def test_samples_against_a_plain_version(spark):
    got = S.samples(docs(spark, TEXTS), size=16).orderBy("ledger_offset").collect()
    want = plain_samples(TEXTS, 16)
    assert [r["ledger_offset"] for r in got] == list(range(len(want)))
    for r, w in zip(got, want, strict=True):
        assert {k: r[k] for k in w} == w
        assert r["loss_mask_hash"] == hashlib.sha256(bytes(w["loss_mask"])).hexdigest()
    assert S.samples(docs(spark, [])).count() == 0


def test_replay_and_what_tampering_does(spark):
    d = docs(spark, TEXTS)
    made = S.streams(d)
    events = S.committed(S.samples(d, size=16))
    assert S.compared(events, S.replayed(events, made, size=16)).where("not matched").count() == 0
    bent = events.withColumn("token_span_ids", F.when(F.col("ledger_offset") == 1, F.transform("token_span_ids", lambda s: F.regexp_replace(s, "^[0-9]+:", "0:"))).otherwise(F.col("token_span_ids")))
    hashed = events.withColumn("loss_mask_hash", F.when(F.col("ledger_offset") == 2, F.lit("0" * 64)).otherwise(F.col("loss_mask_hash")))
    gone = events.withColumn("token_span_ids", F.when(F.col("ledger_offset") == 0, F.array(F.lit("77:0:5"))).otherwise(F.col("token_span_ids")))
    for bad, at in ((bent, 1), (hashed, 2), (gone, 0)):
        wrong = S.compared(bad, S.replayed(bad, made, size=16)).where("not matched").collect()
        assert [r["ledger_offset"] for r in wrong] == [at]
    got = {r["ledger_offset"]: r for r in queries.replay(d).collect()}
    assert all(r["matched"] and not r["matched_elsewhere"] for r in got.values())


@pytest.mark.parametrize("field, change, kind", [
    ("loss_mask", lambda a: a[:-1], "ragged_arrays"), ("seq_len", lambda a: a + 1, "wrong_seq_len"), ("loss_mask_hash", lambda a: "0" * 64, "loss_mask_hash_mismatch"), ("loss_mask", lambda a: [*a[:-1], 1], "padding_is_loss_bearing"),
    ("segment_ids", lambda a: a[::-1], "segment_ids_not_monotonic"), ("position_ids", lambda a: [5, *a[1:]], "position_ids_not_reset_per_document"), ("token_span_ids", lambda a: [a[0] + "9", *a[1:]], "token_span_length_mismatch"),
])
def test_each_violation_is_found(spark, field, change, kind):
    rows = S.samples(docs(spark, TEXTS), size=16)
    assert S.violations(rows).where(F.size("violations") > 0).count() == 0
    last = rows.orderBy(F.desc("ledger_offset")).first().asDict()
    assert last["tokens"][-1] == S.PAD
    last[field] = change(last[field])
    found = S.violations(spark.createDataFrame([last], rows.schema)).first()["violations"]
    assert kind in found and set(found) <= set(S.VIOLATIONS)


def test_attended_pairs_follow_the_predicate(spark):
    for r in S.samples(docs(spark, TEXTS), size=16).select("segment_ids", S.attended(F.col("segment_ids")).alias("n")).collect():
        s = r["segment_ids"]
        assert r["n"] == sum(s[i] == s[j] for i in range(len(s)) for j in range(i + 1))


def test_microbatches_keep_the_order(spark):
    d = docs(spark, TEXTS)
    packed = S.samples(d, size=16)
    first = S.microbatches(packed, 3).orderBy("microbatch").first()
    assert first["tokens"] == [r["tokens"] for r in packed.orderBy("ledger_offset").limit(3).collect()]


def test_shards_are_named_by_content(spark):
    got = {r["id"]: r for r in S.shards(docs(spark, ["one two", "One  two", "one three", None])).collect()}
    assert got["0"]["shard_id"] == got["1"]["shard_id"] != got["2"]["shard_id"] and "3" not in got and got["0"]["token_count"] == 2


LOG = "event string, ledger_offset long, run_branch_id string, shard_ids array<string>, token_span_ids array<string>, loss_mask_hash string"


def test_resume(spark):
    rows = [("batch_committed", i, "a", [f"s{i}"], [f"s{i}:0:9"], "f") for i in range(30)] + [("batch_committed", 100 + i, "b", ["s"], ["s:0:9"], "f") for i in range(4)]
    got = {r["run_branch_id"]: r for r in queries.resumed(spark.createDataFrame(rows, LOG)).collect()}
    assert (got["a"]["crash_step"], got["a"]["resume_step"], got["a"]["rolled_back"], got["a"]["resume_offset"], got["a"]["matched"]) == (14, 10, 5, 10, True) and got["a"]["no_repeat"]
    assert got["b"]["resume_step"] == 0 and got["b"]["resume_offset"] is None
    again = [*rows, ("batch_committed", 10, "a", ["other"], ["s10:0:9"], "f")]
    bad = {r["run_branch_id"]: r for r in queries.resumed(spark.createDataFrame(again, LOG)).collect()}
    assert not bad["a"]["matched"] and not bad["a"]["no_repeat"] and bad["b"]["no_repeat"]


def test_decisions_follow_gate_score_floor_and_stage(spark):
    cols = "shard_id string, never_train boolean, benchmark_overlap_pct double, canary_match boolean, benchmark_derived boolean"
    m = spark.createDataFrame([("ok", None, None, None, None), ("n", True, 0.0, False, False), ("o", False, 25.5, False, False), ("at", False, 25.0, False, False), ("c", False, 0.0, True, False), ("d", False, 0.0, False, True)], cols)
    low = next(f"q{i}" for i in range(99) if int(hashlib.sha256(f"q{i}".encode()).hexdigest()[:8], 16) / 2**32 < 0.28)
    high = next(f"q{i}" for i in range(99) if int(hashlib.sha256(f"q{i}".encode()).hexdigest()[:8], 16) / 2**32 > 0.5)
    batch = lambda i, lane, stage, candidate, *shards: ("batch_committed", i, lane, stage, candidate, list(shards))
    rows = [batch(i, "general", "foundation", high, "ok") for i in range(100)] + [
        batch(200, "general", "foundation", high, "ok", "n"), batch(201, "general", "foundation", high, "o"), batch(202, "general", "foundation", high, "c"), batch(203, "general", "foundation", high, "d"), batch(204, "general", "foundation", high, "at"),
        batch(205, "agentic", "foundation", low, "ok"), batch(206, "general", "foundation", low, "ok"), *(batch(300 + i, "indic", "foundation", low, "ok") for i in range(6)), *(batch(400 + i, "indic", "anneal", low, "ok") for i in range(6)),
    ]
    e = spark.createDataFrame(rows, "event string, ledger_offset long, mixture_lane string, curriculum_stage string, opus_decision_id string, shard_ids array<string>")
    got = {r["ledger_offset"]: r for r in execution.decided(e, m).collect()}
    assert {got[i]["reason"] for i in (200, 201, 202, 203)} == {"eval_firewall_overlap"} and got[204]["decision"] == "accepted"
    assert (got[205]["decision"], got[205]["override"]) == ("protected", True) and (got[206]["decision"], got[206]["reason"]) == ("rejected", "below_proxy_threshold")
    assert (got[300]["decision"], got[300]["reason"]) == ("deferred", "deferred_for_anneal") and got[400]["decision"] == "rejected"
    assert {r["reason"] for r in got.values()} - {None} <= set(execution.REASONS)


EVENTS = "event string, ledger_offset long, run_branch_id string, shard_ids array<string>, token_span_ids array<string>, seq_len int, loss_mask_hash string, opus_decision_id string, mixture_lane string, microbatch_count int"
SHARDS = "shard_id string, tokenizer_hash string, eval_overlap_status string, admission string, dedup_status string"


@pytest.mark.parametrize("change, row", [
    ({}, None), ({"manifest": ("s1", "u", "clear", "admitted", "unique")}, "tokenizer_integrity"), ({"manifest": ("s1", "t", "hit", "blocked", "unique")}, "evaluation_firewall"), ({"manifest": ("s9", "t", "clear", "admitted", "near_duplicate_of:s1")}, "data_cleaning"),
    ({"loss_mask_hash": "x"}, "packing_correctness"), ({"mixture_lane": "code"}, "mixture_compliance"), ({"opus_decision_id": None}, "decision_audit"), ({"ledger_offset": 77}, "crash_recovery"), ({"token_span_ids": ["s2:0:9"]}, "replay"),
    ({"shard_ids": ["far"], "token_span_ids": ["far:0:9"]}, "learning_trace"), ({"microbatch_count": 0}, "throughput"),
])
def test_evidence_turns_with_a_tampered_row(spark, change, row):
    names = [c.split()[0] for c in EVENTS.split(", ")]
    rows = [dict(zip(names, ("batch_committed", i, "a", [f"s{i}"], [f"s{i}:0:9"], 16, "f" * 64, "d", "general" if i < 5 else "code", 1), strict=True)) for i in range(10)]
    manifest = [(f"s{i}", "t", "clear", "admitted", "unique") for i in range(10)]
    if "manifest" in change:
        manifest.append(change["manifest"])
    else:
        rows[-1].update(change)
        if row == "mixture_compliance":
            rows[0].update(change)
    e = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], EVENTS)
    x = spark.createDataFrame([("one", 0.0, 1.0, "general", 50.0), ("one", 0.0, 1.0, "code", 50.0)], "stage string, band_lo double, band_hi double, lane string, share_pct double")
    failed = [r["requirement"] for r in ledger.evidence(e, spark.createDataFrame(manifest, SHARDS), x).collect() if r["result"] == "FAIL"]
    assert failed == ([row] if row else [])


@pytest.mark.parametrize("seed", range(3))
def test_fits_against_plain_loops(seed):
    gen = random.Random(seed)
    sizes = [gen.randrange(1, 60) for _ in range(300)]
    first, rooms = [], []
    for n in sizes:
        b = next((i for i, r in enumerate(rooms) if r >= n), None)
        if b is None:
            b = len(rooms)
            rooms.append(100)
        rooms[b] -= n
        first.append(b)
    assert execution.first_fitting(sizes, 100) == first
    best, rooms = [], []
    for n in sizes:
        b = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: (rooms[i], i), default=None)
        if b is None:
            b = len(rooms)
            rooms.append(100)
        rooms[b] -= n
        best.append(b)
    assert execution.best_fitting(sizes, 100) == best


def test_each_lane_is_packed_by_its_policy(spark):
    rows = [(i, "w " * n, lane) for i, (n, lane) in enumerate([(6, "a"), (5, "a"), (4, "a"), (6, "b"), (5, "b"), (4, "b"), (25, "c"), (3, "c"), (2000, None), (0, "a")])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lane string")
    p = spark.createDataFrame([("a", "best_fit", 10), ("b", "concat_and_chop", 10), ("c", "long_context", 20)], "lane string, policy string, seq_len int")
    got = {r["lane"]: (r["policy"], r["seq_len"], r["bins"], r["used"]) for r in execution.dispatched(d, p).collect()}
    assert got == {"a": ("best_fit", 10, 2, 15), "b": ("concat_and_chop", 10, 2, 18), "c": ("long_context", 20, 2, 23), "none": ("one_document", 1024, 1, 1024)}


def test_packing_policies():
    assert formulas.simulated([5, 6, 4], 10, "chop") == [[5], [6, 4]] and formulas.simulated([5, 6, 4], 10, "pad") == [[5], [6], [4]]
    assert formulas.simulated([5, 6, 5], 10, "greedy") == [[5, 5], [6]] and formulas.simulated([3, 7, 6], 10, "best") == [[7, 3], [6]]
    assert formulas.simulated([2, 2, 2], 10, "structured") == [[2, 2], [2]]


def test_stored_figures_that_do_not_follow_show(spark):
    got = {r["holds"] for r in formulas.recompute(spark).where("workers = 4").collect()}, {r["holds"] for r in formulas.recompute(spark).where("workers = 18 and prefetch = 6").collect()}
    assert got == ({True}, {False})


@pytest.mark.parametrize("scheme", codes.SCHEMES)
def test_sparse_codes_read_back_as_dense_ones(scheme):
    gen = random.Random(4)
    words = [b"a", b"river", "नमस्ते".encode(), *(bytes(gen.randrange(97, 104) for _ in range(gen.randrange(1, 40))) for _ in range(60))]
    for w in words:
        for width in (8, 16):
            code = codes.dense_code(w, width, scheme)
            assert abs(code.mean()) < 1e-9 and codes.decoded_code(code, width) == codes.read_back(w, width, scheme)
            if len(w) <= width and scheme != "squeeze_all":
                assert codes.read_back(w, width, scheme) == w


def test_survey_counts_shared_codes(spark):
    d = docs(spark, ["abcdefghijklmnopqr abcdefghijklmnopqs short", None])
    got = {(r["width"], r["scheme"]): r for r in codes.code_survey(d).collect()}
    assert (got[16, "trunc"]["n"], got[16, "trunc"]["collided"], got[16, "trunc"]["cropped"], got[16, "trunc"]["bytes_lost"]) == (3, 2, 2, 4)
    assert got[16, "wrap"]["collided"] == 0 and got[32, "trunc"]["cropped"] == 0


def test_projections_bring_words_back():
    basis = codes.orthonormal(256 * 8, 512)
    assert np.allclose(basis.T @ basis, np.eye(512), atol=1e-4)
    words = [b"river", "नदी".encode()[:8], b"a", b""]
    assert codes.recovered(words, 8, basis) == words and codes.recovered(words, 8, np.eye(2048, dtype=np.float32)) == words


@pytest.mark.parametrize("block", [10**9, 300])
def test_nearest_against_all(spark, block):
    gen = np.random.default_rng(1)
    x = gen.normal(size=(301, 8)).astype(np.float32)
    e = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(500, None, 0)], "vec_id long, embedding array<float>, b int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = unit.astype(np.float64) @ unit.astype(np.float64).T
    np.fill_diagonal(c, -2)
    got = {r["vec_id"]: r["nearest"] for r in codes.nearest(e, e.where("vec_id % 100 = 0"), block).collect()}
    assert got == {i: int(c[i].argmax()) for i in (0, 100, 200, 300)}


def test_delta_rule_in_chunks_is_the_same():
    xs = np.random.default_rng(2).normal(size=(37, 6)) / 3
    state, reads = np.zeros((6, 6)), []
    for x in xs:
        state, r = kernels.delta_step(state, x)
        reads.append(r)
    for size in (1, 5, 8, 64):
        assert np.allclose(kernels.chunked_delta(xs, size=size), np.stack(reads))


def test_latent_ranks_hold_what_eigenvalues_say(spark):
    x = np.random.default_rng(3).normal(size=(90, 5)) * [4, 2, 1, 0.5, 0.1]
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    s = np.linalg.svd(x, compute_uv=False) ** 2
    got = [r["held_10k"] for r in kernels.latent_compression(e).orderBy("rank").collect()]
    assert np.allclose(got, 10_000 * np.cumsum(s) / s.sum(), atol=1)
    assert kernels.latent_compression(e.limit(0)).count() == 0


def test_overlap_of_records_delivered_again(spark):
    a, b = " ".join(f"w{i}" for i in range(12)), " ".join(f"v{i}" for i in range(12))
    d = spark.createDataFrame([("one", a), ("one", a), ("two", a), ("two", b), ("none", None)], "doc_id string, text string")
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert {r["doc_id"]: (r["matched"], r["total"]) for r in dedup.overlap(d, items, 8).collect()} == {"one": (5, 5), "two": (5, 10)}


def test_dialects_become_one(spark):
    texts = ["[USER]how[ASSISTANT]fine", "<USER>how</USER><ASSISTANT>fine</ASSISTANT>", "### Instruction:how### Response:fine", "### Topic: Law\n### Question:how", "nothing", None]
    got = {r["doc_id"]: r for r in cleaning.unified_dialects(docs(spark, texts)).collect()}
    assert {got[i]["unified"] for i in range(3)} == {"<|user|>how<|assistant|>fine<|end|>"} and [got[i]["dialects"] for i in range(5)] == ["bracket", "tag", "instruction", "header", ""]
    assert got[3]["unified"] == "<|system|>Topic: Law\n<|user|>how<|end|>" and got[4]["unified"] == "nothing" and got[5]["unified"] == ""


def test_all_five_steps(spark):
    got = cleaning.fully_normal(docs(spark, ["x &amp; é​ \x07 a  b", None, "clean"])).orderBy("doc_id").collect()
    assert got[0]["normal"] == "x & é a b" and got[0]["ops"] == ["html_unescape", "nfc", "strip_noise", "strip_control", "collapse_ws"] and got[1]["normal"] == "" and got[2]["ops"] == []


def test_positions_differ_across_branches(spark):
    from lodeworks.sources import io

    c = spark.createDataFrame([("a", 9, "c1"), ("b", 9, "c2"), ("a", 19, "c3")], "run_branch_id string, ledger_offset long, checkpoint_id string")
    first = io.append_checkpoints(None, c)
    assert sorted(r["index_position"] for r in io.append_checkpoints(first, c).collect()) == list(range(6))


def test_a_rollback_that_was_broken_off_does_not_count(spark, tmp_path):
    from lodeworks.sources import io

    book = io.VersionedLedger(spark, str(tmp_path / "l"))
    book.append(spark.createDataFrame([("batch_committed", i) for i in range(4)], "event string, ledger_offset long"))
    (tmp_path / "l" / "v1").mkdir()
    assert book.read().count() == 4 and book.truncate_after(1) == 2 and book.read().count() == 2


def test_every_query_without_sql_can_be_collected(spark):
    from lodeworks.queries import ORACLES, QUERIES

    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").toPandas() is not None, name
