import functools
import random
import re
import unicodedata
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import encoding, forms, leakage, mixing, nearcopies, packing, personal, residue, residue_texts
from lodeworks.queries import QUERIES  # noqa: F401

TEXTS = "doc_id string, text string, key string, id string, fixes string"


def table(spark, rows):
    """Rows of (id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", "x", "f") for i, t in rows], TEXTS)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# -- forms


@pytest.mark.parametrize("a, b", [("ｗｉｄｅ １", "wide 1"), ("été", "été"), ("ﬁne oﬃce", "fine office"), ("so­ft​", "soft"), ("a b c", "a b c"), ("re‑do", "re-do"), ("Ångström", "Ångström")])
def test_folded(a, b):
    assert forms.fold(a) == b


@pytest.mark.parametrize("a, b", [("x²", "x2"), ("A", "a"), ("é", "e"), ("a  b", "a b"), ("a\nb", "a b"), ("a–b", "a-b")])
def test_seen_differences_stay(a, b):
    assert forms.fold(a) != forms.fold(b)


def test_lookalikes_need_a_known_word():
    assert forms.proposals("the сосоа рlant") == {"сосоа": "cocoa", "рlant": "plant"}
    assert forms.form("the рlant", frozenset({"plant"})) == "the plant"
    assert forms.form("the рlant", frozenset({"other"})) == "the рlant"
    assert not forms.proposals("совсем русский текст") and forms.proposals("совсeм русский текст") == {"совсeм": "совсем"}


@pytest.mark.parametrize("most", [1000, 0])
def test_pairs_that_look_the_same(spark, most):
    rows = [("a", "the plant grew"), ("b", "the рlant grew"), ("b", "the рlant grew"), ("c", "the plаnt grew"), ("d", "The plant grew"), ("e", None), ("f", ""), ("g", "  "), ("h", "  "), ("i", "the plant grew"), (None, "the рlant grew")]
    found = forms.lookalike_pairs(table(spark, rows), max_words=most)
    assert pairs(found) == [("a", "b"), ("a", "c"), ("b", "c"), ("b", "i"), ("c", "i")]
    assert found.columns == ["doc_id_a", "doc_id_b"]
    same = {r["doc_id"]: r["text"] for r in forms.unified(table(spark, rows), max_words=most).collect()}
    assert same["b"] == same["a"] and same["e"] is None and same["f"] == ""


# -- near copies


def jaccard(a, b, k=5):
    s, t = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)} for w in (nearcopies.words(a), nearcopies.words(b)))
    return len(s & t) / len(s | t)


def near_rows():
    gen = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{gen.randrange(400)}" for _ in range(gen.choice([20, 60, 120]))]
        for c in range(4):
            w = list(base)
            for _ in range(c):
                w[gen.randrange(len(w))] = "odd"
            rows.append((f"{g:02d}-{c}", " ".join(w)))
    rows += [("x1", "same short"), ("x2", "Same  short"), ("y", None), ("z", " "), ("x1", "same short")]
    return rows


@pytest.mark.parametrize("crowd, ids", [(40, 10_000), (1, 10_000), (40, 0)])
def test_near_copies_against_all_pairs(spark, crowd, ids):
    rows = {i: t for i, t in near_rows() if t and t.strip()}
    want = sorted((a, b) for a in rows for b in rows if a < b and jaccard(rows[a], rows[b]) >= 0.7)
    assert pairs(nearcopies.near_copy_pairs(table(spark, near_rows()), crowd=crowd, max_ids=ids)) == want and len(want) > 20


def test_groups_are_connected(spark):
    found = {r["doc_id"]: r for r in nearcopies.near_copy_groups(table(spark, near_rows())).collect()}
    for a, b in pairs(nearcopies.near_copy_pairs(table(spark, near_rows()))):
        assert found[a]["group_id"] == found[b]["group_id"]
    assert found["x1"]["class_id"] == found["x2"]["class_id"] == "x1" and "y" not in found


def test_posterior_cuts_never_lose_a_true_match():
    assert all(least <= size * 0.7 for size, least in nearcopies.posterior_cuts(0.7))


def test_unsettled_groups_are_an_error(spark):
    chain = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(10):
        rows.append((f"c{9 - i if i % 2 else i}", " ".join(chain)))
        chain[i * 8] = f"v{i}"
    with pytest.raises(RuntimeError):
        nearcopies.near_copy_groups(table(spark, rows), rounds=1)


# -- leakage


def test_corpus_and_items_are_read_alike(spark):
    words = [f"q{i}" for i in range(5)] + ["plant"] + [f"q{i}" for i in range(6, 14)]
    docs = [("a", " ".join(words)), ("b", "the рlant"), ("c", "the plаnt")]
    item = spark.createDataFrame([(1, " ".join(words).replace("plant", "рlant"))], "item_id long, text string")
    assert pairs(leakage.leaked(table(spark, docs), item)) == [("a", 1)]


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_leaks_against_windows(spark, most):
    gen = random.Random(9)
    items = [(n, " ".join(f"q{gen.randrange(500)}" for _ in range(30))) for n in range(8)] + [(50, "too short"), (51, None)]
    words = items[0][1].split()
    docs = [("a", "pre " + " ".join(words[3:16]) + " post"), ("b", "pre " + " ".join(words[3:15]) + " post"), ("c", items[1][1].upper()), ("d", None), ("e", ""), ("a", "pre " + " ".join(words[3:16]) + " post")]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert pairs(leakage.leaked(table(spark, docs), b, max_windows=most)) == [("a", 0), ("c", 1)]
    assert leakage.leaked(table(spark, []), b).count() == 0 and leakage.leaked(table(spark, docs), b.limit(0)).count() == 0


def test_blocks_find_all_within_the_radius():
    index = leakage.Index([(1, " ".join(f"q{i}" for i in range(40)))], 13, 2)
    for bit in range(64):
        flipped = index.prints ^ np.uint64(1 << bit)
        mine, theirs = index.near(flipped)
        assert set(range(len(flipped))) <= {m for m, t in zip(mine, theirs, strict=True) if m == t}


# -- encoding


def test_ids_equal_the_public_tokenizer():
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    texts = ["Hello  world\n\n it's 12,345", " ", "\n \n x", "<|endoftext|>", "हिन्दी पाठ", "a　 b", "é" * 300, "\x00\x1c", "  tail  ", "don't DON'T"]
    mine = encoding.encoder()
    assert [mine.encode(t) for t in texts] == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    assert all(mine.decode(mine.encode(t)) == t for t in texts)


def test_null_and_empty_texts_are_empty_lists(spark):
    got = {r["doc_id"]: r["ids"] for r in encoding.encoded(table(spark, [("a", None), ("b", ""), ("c", "hi")])).collect()}
    assert got["a"] == got["b"] == [] and len(got["c"]) == 1
    assert encoding.encoded(table(spark, [])).count() == 0


# -- packing


def test_packing_keeps_every_token(spark):
    gen = random.Random(4)
    rows = [(i, "word " * gen.choice([0, 3, 200, 900, 2500]) or None, gen.choice(["general", "code", None, "new"])) for i in range(80)]
    d = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, lane string")
    policy = spark.createDataFrame([("general", "p", 512), ("code", "p", 1024), (None, "p", 9)], "lane string, policy string, seq_len int")
    placed = packing.packed(d, policy, chunk=20).cache()
    sizes = encoding.token_counts(d, {"doc_id": "doc_id"}).agg(F.sum("n_tokens")).first()[0]
    assert placed.agg(F.sum("n_tokens")).first()[0] == sizes
    boxes = packing.containers(placed)
    assert boxes.where("fill > capacity or fill <= 0").count() == 0
    assert placed.where("n_tokens < capacity and piece > 0 and start % capacity != 0").count() == 0
    assert {(r["lane"], r["capacity"]) for r in boxes.select("lane", "capacity").distinct().collect()} <= {("general", 512), ("code", 1024), (None, 1024), ("new", 1024)}
    assert packing.packed(d.limit(0), policy).count() == 0


def test_sum_of_squares_fills():
    at, fills = packing.sum_of_squares(np.array([6, 4, 6, 4, 10, 3]), 10)
    assert sorted(fills.tolist()) == [3, 10, 10, 10] and len(at) == 6


# -- mixing


def shards(spark, rows):
    return spark.createDataFrame(rows, "shard_id string, capability_lane string, token_count long, generated_at timestamp_ntz, doc_ids array<string>, stage string")


@pytest.mark.parametrize("range_", [20_000, 10])
def test_draws_equal_the_sql(spark, range_):
    gen = random.Random(2)
    from datetime import datetime

    rows = [(f"s{i}", gen.choice(["a", " A", "B", None]), gen.choice([10, 25, 70, None, -1, 10**7]), datetime(2025, 1, 1 + i % 20), [f"d{i}"], "z") for i in range(300)]
    rows += [("odd", "a", 40, None, None, "z"), ("far", "b", 99, None, ["gone"], "z"), (None, "a", 5, None, ["d1"], "z")]
    m = shards(spark, [*rows, *rows[:40]])
    r = spark.createDataFrame([(f"d{i}", "x" * 90, "k") for i in range(300)] + [("d0", "x", "k"), ("d1", None, "k")], "doc_id string, text string, lane string")
    f = spark.createDataFrame([("one", "a", 60.0, 5), ("one", "b", 40.0, None), ("one", "b", 40.0, None)], "stage string, lane string, need double, supply long")
    x = spark.createDataFrame([("one", "a", 50.0, 3, 12000), ("one", "b", 50.0, 2, 12000), ("one", "gone", 0.0, 1, 12000)], "stage string, lane string, share_pct double, max_repeats int, token_budget long")
    con = duckdb.connect()
    for name, df in (("manifest", m), ("feasibility", f), ("mixture", x), ("run_pipeline", r)):
        con.register(name, df.toPandas())
    mine = sorted(tuple(r) for r in mixing.drawn(m, f, x, r, range_=range_).select("stage", "lane", "shard_id", "token_count", "uses").collect())
    assert mine == sorted(con.execute(mixing.DRAWN_SQL).fetchall()) and mine and "odd" in {r[2] for r in mine}
    report = {r["lane"]: r for r in mixing.report(m, f, x, r, range_=range_).collect()}
    assert report["a"]["most_uses"] <= 3 and report["gone"]["tokens"] == 0
    none = {lane: [t for _, l, t, *_ in rows if _ is not None and (l or "").strip().lower() == lane and (t is None or t < 1 or t == 10**7)] for lane in ("a", "b")}
    for lane in ("a", "b"):
        assert report[lane]["left_out"] == len(none[lane]) and report[lane]["left_out_tokens"] == sum(max(t or 0, 0) for t in none[lane])
    assert mixing.drawn(m.limit(0), f, x, r).count() == 0


# -- personal data

NAMES = [(1, "Anika", "given"), (2, "June", "given"), (3, "Brenokov", "family"), (4, "Yarolin", "family"), (5, "Grace", "given")]


@pytest.mark.parametrize("text, kinds", [
    ("Write to a.b+c@ridge.test now", {"email"}), ("ask max [at] mail [dot] ridge [dot] test", {"email"}), ("oleg AT ridge DOT example", {"email"}), ("the score was 313@809 today", set()), ("@cached def x", set()),
    ("call +49 30 23125279 now", {"phone"}), ("call 01 99 00 71 16 now", {"phone"}), ("reached (307) 555-0129 twice", {"phone"}), ("Order ref 48-519-1177 covers it", set()), ("Version 404.714.264 of it", set()),
    ("batch 664-501-547 left", set()), ("server 192.0.2.108 held", set()), ("Catalogue number 978-0-00-149-4 is", set()),
    ("tenant as 000-53-0193. 889 of the", {"id_number"}), ("passport no. B0015919 was", {"id_number"}), ("form asks for a passport no. but has none", set()), ("citizen number ZE-227-8523", {"id_number"}), ("0121-0310 1297 was typed", {"id_number"}),
    ("lives at 90 Elmry Rd, Ostamere 84195", {"address"}), ("left outside Cobardsweg 85, 17823 Dundihalli", {"address"}), ("went to 156 rue des Thistours, 69860 Haltocroft", {"address"}), ("Harbour Road was closed", set()),
    ("prize to Anika Brenokov today", {"name"}), ("by Dr. Yarolin today", {"name"}), ("ANIKA M. YAROLIN | x", {"name"}), ("Grace and patience in June, and", set()), ("The Brenokov Foundation met", set()), ("wrote to [EMAIL] and rang [PHONE]", set()),
    ("see https://www.x-uneven.example/a/540 now", set()),
])
def test_kinds(text, kinds):
    given, family = ({n.lower() for _, n, k in NAMES if k == kind} for kind in ("given", "family"))
    parts = personal.Parts(given, family, set(), set(), {"anika"})
    assert {k for _, _, k in personal.findings(text, parts)} == kinds


def test_masks_keep_the_rest(spark):
    rows = [("a", "Ask Anika Brenokov, ａ@ridge.test​ ok"), ("b", "ask Anika Brenokov again"), ("c", None), ("d", ""), ("e", "nothing"), ("f", "by Zed Brenokov")]
    names = spark.createDataFrame(NAMES, "part_id long, name_part string, kind string")
    got = {r["doc_id"]: r for r in personal.masked(table(spark, rows), names, "k").collect()}
    assert got["a"]["masked"] == "Ask [NAME], [EMAIL]​ ok" and got["c"]["masked"] is None and got["e"]["masked"] == "nothing" and got["d"]["counts"] == {}
    name = got["b"]["surrogate"].removeprefix("ask ").removesuffix(" again")
    assert name in got["a"]["surrogate"] and name != "Anika Brenokov"
    assert personal.collisions(personal.entities(table(spark, rows), names, "k")).count() == 0
    assert ("f", "name") in pairs(personal.kinds_found(table(spark, rows), names))
    assert personal.kinds_found(table(spark, []), names.limit(0)).count() == 0


def test_more_parts_than_go_to_a_worker(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = [f"Q{a}{b}ov" for a in letters[:4] for b in letters[:6]]
    rows = [(f"g{i}", f"so {w} Brenokov said") for i, w in enumerate(odd)] + [(f"f{i}", f"so Anika {w}elm-Hartwig said") for i, w in enumerate(odd)] + [(f"h{i}", f"by {w} Hartwig today, and ｂy {odd[i - 1]} {w}elm") for i, w in enumerate(odd)]
    rows += [("p", "ANIKA BRENOKOV | X"), ("q", "anika brenokov was here"), ("r", "Dr. Yarolin-Brenokov left"), ("s", None), ("t", ""), ("u", "Grace said Grace may"), *rows[:2]]
    names = spark.createDataFrame(NAMES, "part_id long, name_part string, kind string")
    d, few = table(spark, rows), len({(n.lower(), k) for _, n, k in NAMES})
    sort = lambda df: sorted(map(str, df.collect()))
    for operator in (personal.kinds_found, functools.partial(personal.masked, key="k"), functools.partial(personal.entities, key="k")):
        assert sort(operator(d, names, max_parts=few)) == sort(operator(d, names))
    assert {(f"g{i}", "name") for i in range(len(odd))} <= set(pairs(personal.kinds_found(d, names, max_parts=few)))
    with pytest.raises(ValueError):
        personal.kinds_found(d, names, max_parts=few - 1)


def test_cipher_is_one_to_one():
    made = personal.Surrogates("k", personal.Parts(set(), set(), set(), set(), set()))
    assert len({made.cipher(f"{i:04d}") for i in range(10_000)}) == 10_000


SCRIPTS = personal.Parts({"иван", "олег", "राम", "मोहन", "élodie", "anika", "grace", "june"}, {"петров", "сидоров", "शर्मा", "वर्मा", "brenokov", "yarolin"}, set(), set(), set())


@pytest.mark.parametrize("text, kind", [
    ("Иван Петров", "name"), ("Петров Иван Сидоров", "name"), ("Борис Ёлкин", "name"), ("राम शर्मा", "name"), ("सीता गुप्ता", "name"), ("Élodie Dupré", "name"), ("Zoë Çelik-Đorđević", "name"), ("Dr. Yarolin", "name"), ("가나 다라", "name"), ("ఆనంద్ రావు", "name"),
    ("jane@janedoe.com", "email"), ("иван@почта.рф", "email"), ("joe at foo dot bar dot com", "email"), ("+49 30 23125279", "phone"), ("AB-123-4567", "id_number"), ("9", "id_number"), ("90 Elmry Rd, Ostamere 84195", "address"),
])
def test_surrogates_of_every_script(text, kind):
    made = personal.Surrogates("k", SCRIPTS)
    entity = personal.canonical(text, kind)
    other = made.of(entity, kind)
    assert other != entity and made.of(entity, kind) == other and personal.Surrogates("l", SCRIPTS).of(entity, kind)
    shape = lambda s: [(c.isdigit(), c.isupper(), c if not (c.isalnum() or unicodedata.category(c)[0] == "M") else "") for c in s]
    if kind != "name" or not any(w.casefold() in made.pool for w in entity.split()):
        assert len(other) == len(entity) and shape(other) == shape(entity)
    words = [[w.casefold() for w in re.findall(r"[^\W\d_]{3,}", x)] for x in (entity, other)]
    assert kind == "address" or not [a for a, b in zip(*words, strict=False) if a == b and a not in ("com", "dot", "рф")]


def test_surrogates_need_a_key_and_keep_gender_and_public_domains():
    with pytest.raises(ValueError):
        personal.Surrogates("", SCRIPTS)
    made = personal.Surrogates("k", personal.Parts({"anna", "berta", "carl", "dirk"}, set(), set(), set(), set()), {"anna": "f", "berta": "f", "carl": "m", "dirk": "m"})
    assert made.of("Anna", "name") == "Berta" and made.of("Carl", "name") == "Dirk"
    assert made.of("ann@gmail.com", "email").endswith("@gmail.com") and not made.of("ann@annsmith.org", "email").endswith("annsmith.org")


def test_genders_come_from_the_corpus(spark):
    rows = [("a", "Mrs. Anika Brenokov said she was late"), ("b", "Grace Brenokov lost her hat"), ("c", "Mr June Yarolin and his dog"), ("d", None)]
    names = spark.createDataFrame(NAMES, "part_id long, name_part string, kind string")
    source, known, parts = personal._prepared(table(spark, rows), names, "doc_id", "text")
    assert personal.genders(source, known, parts) == {"anika": "f", "grace": "f", "june": "m"}


def test_names_in_other_scripts_are_found():
    for text in ("राम शर्मा ने कहा", "then राम शर्मा came", "Потом Иван Петров сказал", "ИВАН ПЕТРОВ"):
        assert {k for _, _, k in personal.findings(text, SCRIPTS)} == {"name"}


# -- residue


@pytest.mark.parametrize("text, found", [
    ("Welcome to {{ city }}, the home of the fund.", True), ("Dear [Your Name], the order is ready.", True), ("The line `Hello {{ name }}` is filled in.", False), ('"[Your Name]" was the commonest signature.', False),
    ("<li>{{ depot.fund }}</li>   {# shown 9 times #}", False), ('echo "${Vault_DIR}/x" > a.log', False), ("<|user|> hello there", False), ("const a = `${b} of 5`;", False), ("Read more about %%CITY%% in our guide.", True),
])
def test_placeholders(text, found):
    assert residue.unfilled(text) is found


def test_residue_against_content(spark):
    gen = random.Random(8)
    words = "river council market garden school bridge library harvest meeting report village season people water road".split()
    content = [(i, ". ".join(" ".join(gen.choices(words, k=9)).capitalize() for _ in range(12)) + ".", "s") for i in range(60)]
    bad = [(100, "404 - The page you asked for could not be found on this server.", "s"), (101, "Skip to content\nLorem ipsum dolor sit amet, consectetur adipiscing elit.\n© Vale Press", "s"), (102, "Please enable JavaScript to view this page.", "s")]
    odd = [(200, None, "s"), (201, "", "s"), (202, " \n ", "s"), (203, content[0][1] + "\nPlease enable JavaScript to view the comments.", "s")]
    d = spark.createDataFrame([*content, *bad, *odd, bad[0]], "doc_id long, text string, residue string")
    assert sorted(r["doc_id"] for r in residue.residue_ids(d).collect()) == [100, 101, 102]
    kept = residue.without_residue(d)
    assert kept.count() == len(content) + len(odd) and kept.columns == d.columns
    assert residue.residue_ids(d.limit(0)).count() == 0


def test_rows_of_one_id_are_judged_apart(spark):
    rows = [(1, "Please enable JavaScript to view this page.", "a"), (1, "The council met at the bridge and the meeting went on until the evening.", "b"), (None, "HTTP Error 503. The service is unavailable.", "c"), (2, None, "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, residue string")
    assert sorted(r["residue"] for r in residue.without_residue(d).collect()) == ["b", "d"]
    assert {r["doc_id"] for r in residue.residue_ids(d).collect()} == {1, None}


def test_the_sample_is_bounded_in_characters(spark):
    d = spark.createDataFrame([(i, f"river {i} " * 50) for i in range(40)] + [(99, "404 Not Found nginx/1.18.0")], "doc_id long, text string")
    for chars in (2500, 10**7):
        assert [r["doc_id"] for r in residue.residue_ids(d, chars=chars, sample=10).collect()] == [99]


def test_the_models_are_fitted_on_every_row(spark):
    long = "harvest road " * 20_000
    texts = [f"river {i % 89} council {i % 97}\tmarket" for i in range(4000)] + [long, "404 Not Found nginx/1.18.0"] * 2
    at = lambda first, parts: spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
    ids = {r["doc_id"] for r in residue.residue_ids(at(0, 2)).collect()}
    assert {i for i, t in enumerate(texts) if t[:3] == "404"} == ids
    models = [residue.fitted(at(first, parts)) for first, parts in ((0, 3), (10**6, 1), (5 * 10**9, 7))]
    for m in models[1:]:  # whatever ids and partitions are
        assert np.array_equal(models[0].residue, m.residue) and np.array_equal(models[0].navigation, m.navigation)
    counted = residue._summed(at(0, 5).select("text"), 2, lambda found: (found, [t for t in found if len(t) > 200_000]))
    plain = Counter(c for t in texts for c in residue.Laid([t]).own().tolist())
    assert {c: int(counted[0][c]) for c in counted[0].nonzero()[0].tolist()} == plain and counted[0].sum() == sum(map(len, texts))
    assert counted[1].sum() == 2 * len(long)


def test_texts_laid_together_are_judged_as_alone(spark):
    texts = ["404 Not Found nginx/1.18.0 İstanbul", "", " \n\t ", "Lorem  ipsum\t dolor sit amet,\n\n  consectetur", "n", "404", "𠀀𠀁 Please enable JavaScript 𠀂 to view this page. ΟΔΟΣ", "Home | News | About\nThe council met at the bridge.", "Lorem ipsum dolor sit am"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = residue.fitted(d)
    together = model.coverages(texts)
    assert together.tolist() == [model.coverages([t])[0].tolist() for t in texts]
    assert together[0][2] > 0.5 and together[6][2] > 0.5 and together[8][2] == 1 and not together[1:3].any() and not together[7].any()
    assert {0, 3, 6, 8} <= {r["doc_id"] for r in residue.residue_ids(d).collect()}


def test_no_training_phrase_is_in_the_test_tables():
    at = Path("/root/testdata/sf0.01/documents.parquet")
    if not at.exists():
        pytest.skip("no test tables here")
    texts = "\0".join(r[0] for r in duckdb.sql(f"SELECT text FROM '{at}' WHERE text IS NOT NULL").fetchall())
    lists = (residue_texts.FILLER, residue_texts.NOTICE, residue_texts.MARKUP, residue_texts.NAVIGATION)
    phrases = {x for part in lists for line in part.split("\n") for x in (line, *re.split(r"(?<=[.!?।])\s+", line)) if len(x) > 12}
    assert len(phrases) > 300 and not [p for p in phrases if p in texts]
