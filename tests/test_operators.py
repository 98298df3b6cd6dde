import random

import pytest
from pyspark.sql import functions as F

from lodeworks.catalog import codes, execution, ledger
from lodeworks.functions import hashing as H
from lodeworks.functions import text as T
from lodeworks.operators import cleaning, dedup, masking, vocabulary


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "text string").select(expression.alias("x")).first()["x"]


def test_normal_form_names_its_steps(spark):
    made, ops = T.normalized(F.col("text"))
    row = spark.createDataFrame([("a​b\x07  c \n\n\n\nd ",)], "text string").select(made.alias("m"), ops.alias("o")).first()
    assert row["m"] == "ab c\n\nd" and row["o"] == ["strip_noise", "strip_control", "collapse_ws"]


def test_entities_and_composition_in_arrow_batches(spark):
    made, ops = T.normalized(F.col("text"), composed=True)
    row = spark.createDataFrame([("x &amp; é",)], "text string").select(made.alias("m"), ops.alias("o")).first()
    assert row["m"] == "x & é" and row["o"] == ["html_unescape", "nfc"]


@pytest.mark.parametrize("text, n", [("", 0), ("one two", 1), ("a b c d e f", 2), ("a b c d e a b c d e", 5)])
def test_runs_of_words(spark, text, n):
    assert len(one(spark, T.grams(T.words(F.col("text")), 5), text)) == n


@pytest.mark.parametrize("text, reasons", [("short", ["too_short"]), ("menu | home | about\n" * 20, ["boilerplate", "dup_lines"]), ("", ["too_short"])])
def test_quality_reasons(spark, text, reasons):
    assert one(spark, T.quality_reasons(F.col("text")), text) == reasons


def test_english_needs_letters_and_stop_words(spark):
    assert one(spark, T.is_english(F.col("text")), "the cat sat on the mat and it was at the door")
    assert not one(spark, T.is_english(F.col("text")), "12345")


def test_masks_in_order(spark):
    made, counts = masking.structured(F.col("text"))
    row = spark.createDataFrame([("see https://x.io a@b.co 10.0.0.1 or 212-555-0100",)], "text string").select(made.alias("m"), *(c.alias(k) for k, c in counts.items())).first()
    assert row["m"] == "see [URL] [EMAIL] [IP] or [PHONE]" and list(row[1:]) == [1, 1, 1, 1]


def test_signature_of_nothing_is_the_prime(spark):
    row = spark.createDataFrame([([],)], "h array<long>").select(H.signature(F.col("h")).alias("s")).first()
    assert set(row["s"]) == {H.PRIME} and len(row["s"]) == H.HASHES


def greedy_by_hand(links):
    kept, out = set(), {}
    for n in sorted({x for l in links for x in l}):
        mine = [a for a, b in links if b == n and a in kept]
        if mine:
            out[n] = min(mine)
        else:
            kept.add(n)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_is_first_seen_order(spark, seed):
    gen = random.Random(seed)
    links = sorted({tuple(sorted(gen.sample(range(14), 2))) for _ in range(18)})
    found = dedup.greedy(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["kept_by"] for r in found} == greedy_by_hand(links)


def test_jaccard_pairs_against_all_pairs(spark):
    gen = random.Random(5)
    base = [[f"w{gen.randrange(60)}" for _ in range(30)] for _ in range(6)]
    texts = []
    for b in base:
        texts.append(b)
        c = list(b)
        c[gen.randrange(30)] = "zz"
        texts += [c, list(b)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(99, None), (98, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows if t}
    reps = {}
    for i, s in sorted(sets.items()):
        reps.setdefault(s, i)
    want = {(a, b) for s, a in reps.items() for t, b in reps.items() if a < b and len(s & t) >= 0.5 * len(s | t)}
    assert {(r["a"], r["b"]) for r in dedup.jaccard_pairs(d, "doc_id", threshold=0.5).collect()} == want and want


def test_byte_pairs_round_trip_and_ties(spark):
    d = spark.createDataFrame([("en", "low lower lowest low"), ("xx", "aa aa")], "lang string, text string")
    model = vocabulary.train(vocabulary.unit_counts(d), 12)
    encode = model.encoder()
    ids = encode(" lower")
    assert "".join(model.symbols[i - 1] for i in ids) == " lower" and encode("é") == [0]
    with pytest.raises(ValueError):
        vocabulary.train(vocabulary.unit_counts(d), -1)


def test_running_totals_over_ranges(spark):
    gen = random.Random(1)
    values = [(i, gen.randrange(9)) for i in range(500)]
    gen.shuffle(values)
    found = {r["k"]: r["before"] for r in cleaning.running(spark.createDataFrame(values, "k long, v long"), "k", "v", ranges=7).collect()}
    total = 0
    for k, v in sorted(values):
        assert found[k] == total
        total += v


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert cleaning.running(none.select("doc_id", F.lit(1).alias("v")), "doc_id", "v").count() == 0
    assert dedup.jaccard_pairs(none, "doc_id").count() == 0 and vocabulary.vocabulary(none).count() == 0


def test_windows_cover_the_text(spark):
    text = "word " * 500
    got = cleaning.windows(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("window").collect()
    assert "".join(r["piece"] for r in got) == text and all(len(r["piece"]) <= 800 for r in got)


def test_tampered_ledger_shows(spark):
    rows = [("batch_committed", i, "run-a", i, [f"s{i}"], [f"s{i}:0:10"], 32, "f" * 64) for i in range(5)]
    cols = "event string, ledger_offset long, run_branch_id string, global_step long, shard_ids array<string>, token_span_ids array<string>, seq_len int, loss_mask_hash string"
    good = spark.createDataFrame(rows, cols)
    assert ledger.violations(good).where("empty_span or over_full or uneven or bad_hash").count() == 0
    assert ledger.no_skip(good).first()["no_skip"] and ledger.replay(good).where("not matched").count() == 0
    bad = spark.createDataFrame([*rows[:3], ("batch_committed", 4, "run-a", 4, ["s9"], ["s4:0:99"], 32, "x")], cols)
    assert ledger.violations(bad).where("over_full and bad_hash").count() == 1
    assert not ledger.no_skip(bad).first()["no_skip"] and ledger.replay(bad).where("not matched").count() == 1


def test_stream_commits_once(spark):
    e = spark.createDataFrame([("batch_committed", i % 4, "run-a") for i in range(12)], "event string, ledger_offset long, run_branch_id string")
    assert sorted(r["ledger_offset"] for r in ledger.stream_ledger(e).collect()) == [0, 1, 2, 3]


def test_floors_hold():
    plan = execution.control_loop({"general": 5, "indic": 3, "reasoning": 2, "agentic": 2}, {"general": 100.0, "indic": 0.0, "reasoning": 0.0, "agentic": 0.0}, 2000, 10, 3)
    share = {k: sum(p[1] == k for p in plan) / 20 for k in execution.FLOORS}
    assert all(share[k] >= f - 0.2 for k, f in execution.FLOORS.items())


def test_bins_stay_within_capacity(spark):
    d = spark.createDataFrame([(i, "general", "w " * (37 * i % 300 + 1)) for i in range(60)], "doc_id long, lane string, text string")
    for best in (True, False):
        assert execution.fitted(d, best).groupBy("bin").agg(F.sum("n").alias("s")).where("s > 1024").count() == 0


def test_remainders_come_back(spark):
    o = spark.range(17017).withColumnRenamed("id", "o_orderkey")
    assert codes.crt(o).where("back != o_orderkey").count() == 0


def test_ledger_versions_and_rollback(spark, tmp_path):
    from lodeworks.sources import io

    book = io.VersionedLedger(spark, str(tmp_path / "ledger"))
    cols = "event string, ledger_offset long, run_branch_id string"
    book.append(spark.createDataFrame([("batch_committed", i, "a") for i in range(6)] + [("checkpoint_bound", None, "a")], cols))
    assert book.truncate_after(2) == 3 and book.read().count() == 4
    book.append(spark.createDataFrame([("batch_committed", 3, "a")], cols))
    assert book.read().where("event = 'batch_committed'").agg(F.max("ledger_offset")).first()[0] == 3


def test_documents_templates_and_budget(spark, tmp_path):
    from lodeworks.sources import io

    io.write_document(spark.createDataFrame([(1, "x")], "n long, s string"), str(tmp_path / "one"))
    (tmp_path / "lines.json").write_text('{"event": "a", "ledger_offset": 1}\n\n{"event": "b"}\n')
    assert io.json_lines(spark, str(tmp_path / "lines.json")).count() == 2
    assert io.fill_template("<script>__DATA__</script>", {"a": "</script>"}) == '<script>{"a": "<\\/script>"}</script>'
    with pytest.raises(ValueError):
        io.fill_template("nothing", {})
    d = spark.createDataFrame([(i, 4) for i in range(10)], "doc_id long, n long")
    assert sorted(r[0] for r in io.within_budget(d, "doc_id", "n", 9).select("doc_id").collect()) == [0, 1, 2]
    c = spark.createDataFrame([("a", 9, "c1"), ("a", 19, "c2")], "run_branch_id string, ledger_offset long, checkpoint_id string")
    first = io.append_checkpoints(None, c)
    assert [r["index_position"] for r in io.append_checkpoints(first, c).orderBy("index_position").collect()] == [0, 1, 2, 3]


def test_names_by_an_injected_recogniser(spark):
    find = lambda texts: [[(t.index("Ann"), t.index("Ann") + 3)] if "Ann" in t else [] for t in texts]
    d = spark.createDataFrame([(1, "so Ann said"), (2, None), (3, "none")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_names"]) for r in masking.names_masked(d, find).collect()}
    assert got == {1: ("so [NAME] said", 1), 2: (None, 0), 3: ("none", 0)}


def test_cleaning_run_end_to_end(spark):
    from lodeworks.plans.cleaning import clean

    gen = random.Random(6)
    say = lambda n: " ".join(gen.choice("the river of and to in a market was for with at this from garden house people they".split()) + gen.choice(["", "", " stone", " light"]) for _ in range(n))
    first, leak = say(90), say(90)
    near = first + " end"
    rows = [("a", first), ("b", near), ("c", first), ("d", say(80) + " mail a@b.co"), ("e", leak), ("f", "short"), ("g", None), ("h", say(80) + " MARK-1"), ("a", first)]
    items = spark.createDataFrame([(1, " ".join(leak.split()[10:40]))], "item_id long, text string")
    kept, report = clean(spark.createDataFrame(rows, "doc_id string, text string"), items, canary="MARK-1")
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert sorted(got) == ["a", "d"] and got["d"].endswith("[EMAIL]")
    counts = [r["docs"] for r in report.collect()]
    assert counts == sorted(counts, reverse=True) and counts[0] == 8


def test_crowded_buckets_lose_no_pair(spark):
    from lodeworks.catalog import dedup as queries

    gen = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(90):
        t = list(base)
        for k in gen.sample(range(300), 4):
            t[k] = f"x{i}.{k}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts)) + [(200 + i, texts[i]) for i in range(3)] + [(300 + i, None) for i in range(70)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = {r["doc_id"]: r["sig"] for r in dedup.banded(d, "doc_id").where("band = 0").collect()}
    ids = sorted(sigs)
    every = [(a, b, sigs[a], sigs[b]) for a in ids for b in ids if a < b]
    shared = {(a, b) for a, b, s, t in every if any(s[k : k + 4] == t[k : k + 4] for k in range(0, 128, 4))}
    near = {(a, b) for a, b, s, t in every if sum(x == y for x, y in zip(s, t, strict=True)) >= 103}
    sizes = [sum(1 for i in ids if sigs[i][k : k + 4] == sigs[j][k : k + 4]) for k in range(0, 128, 4) for j in ids[:90]]
    assert max(sizes) > 64 and 2415 < len(near) < len(shared)
    for found, want in ((queries.lsh_candidates(d), shared), (queries.agreement(d), near)):
        got = [(r["a"], r["b"]) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)
    assert {r["doc_id"] for r in queries.minhash_dedup(d).collect()} == set(greedy_by_hand(sorted(near)))


@pytest.mark.parametrize("n", [60, 6000, 20_000])
def test_bands_cover_the_run_at_any_length(spark, n):
    found = {(r["stage"], r["phase"]): r["n"] for r in execution.stage_bands(spark.range(n).withColumnRenamed("id", "ledger_offset")).collect()}
    share = {("foundation", "early"): 40, ("foundation", "mid"): 15, ("skill_build", "mid"): 15, ("skill_build", "late"): 15, ("anneal", "anneal"): 15}
    assert found == {k: v * n // 100 for k, v in share.items()}
