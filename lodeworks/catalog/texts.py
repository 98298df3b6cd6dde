"""Normalisation, language and quality filters, masking, tokens: queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators import cleaning, masking, vocabulary
from lodeworks.plans.cleaning import clean
from lodeworks.registry import query

WS = T.WS
def _text():
    return T.text_of("text")


_D = "coalesce(text, '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _all(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, '{pattern}')"


def _collapse(x: str) -> str:
    runs = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(f"array_to_string(list_transform(string_split({runs}, chr(10)), lambda l: {_strip('l')}), chr(10))")


_NOISE = "[\\x{200b}\\x{feff}\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{fffd}]"
_CONTROL = "[\\x{1}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}\\x{7f}]"
_words = lambda x: _all(x, f"[^{WS}]+")
_lines = lambda x: f"list_filter(string_split({x}, chr(10)), lambda l: length({_strip('l')}) > 0)"
_gone = lambda x, p: f"length(regexp_replace({x}, '{p}', '', 'g'))"
_ws = lambda x: f"array_to_string({x}, '')"


@query("t03_strip_noise", "documents", sql=f"SELECT doc_id, regexp_replace({_D}, '{_NOISE}', '', 'g') AS cleaned, length({_D}) - {_gone(_D, _NOISE)} AS n_removed FROM documents")
def strip_noise(d: DataFrame) -> DataFrame:
    made = T.strip_noise(_text())
    return d.select("doc_id", made.alias("cleaned"), (F.length(_text()) - F.length(made)).cast("long").alias("n_removed"))


@query("t04_strip_control", "documents", sql=f"SELECT doc_id, regexp_replace({_D}, '{_CONTROL}', '', 'g') AS cleaned, length({_D}) - {_gone(_D, _CONTROL)} AS n_removed FROM documents")
def strip_control(d: DataFrame) -> DataFrame:
    made = T.strip_control(_text())
    return d.select("doc_id", made.alias("cleaned"), (F.length(_text()) - F.length(made)).cast("long").alias("n_removed"))


@query("t05_collapse_ws", "documents", sql=f"SELECT doc_id, {_collapse(_D)} AS text FROM documents")
def collapse(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.collapse(_text()).alias("text"))


_NORMAL = f"""steps AS (SELECT *, regexp_replace(raw, '{_NOISE}', '', 'g') AS a FROM (SELECT *, {_D} AS raw FROM documents)),
controlled AS (SELECT *, regexp_replace(a, '{_CONTROL}', '', 'g') AS b FROM steps), normal AS (SELECT *, {_collapse('b')} AS c FROM controlled)"""


@query("t06_normalize", "documents", sql=f"""WITH {_NORMAL} SELECT doc_id, c AS normal,
array_to_string(list_filter([CASE WHEN a <> raw THEN 'strip_noise' END, CASE WHEN b <> a THEN 'strip_control' END, CASE WHEN c <> b THEN 'collapse_ws' END], lambda x: x IS NOT NULL), ',') AS ops FROM normal""")
def normalize(d: DataFrame) -> DataFrame:
    made, ops = T.normalized(_text())
    return d.select("doc_id", made.alias("normal"), F.array_join(ops, ",").alias("ops"))


@query("t06_normalize_full", "documents")
def normalize_full(d: DataFrame) -> DataFrame:
    return cleaning.fully_normal(d).select("doc_id", "normal", F.array_join("ops", ",").alias("ops"))


@query("t07_normalize_full_stats", "documents")
def normalize_full_stats(d: DataFrame) -> DataFrame:
    """Documents changed by any of the five steps, characters removed, and how many documents each step changed."""
    made = cleaning.fully_normal(d)
    steps = ("html_unescape", "nfc", "strip_noise", "strip_control", "collapse_ws")
    return made.agg(
        F.count_if(F.col("normal") != F.col("raw")).alias("docs_modified"), F.sum(F.greatest(F.lit(0), F.length("raw") - F.length("normal"))).alias("chars_removed"),
        F.sum(F.length("raw") - F.length(T.strip_noise(F.col("raw")))).alias("zero_width_removed"), *(F.count_if(F.array_contains("ops", s)).alias(s) for s in steps),
    )


@query("t07_normalize_stats", "documents", sql=f"""WITH {_NORMAL} SELECT count(*) FILTER (WHERE c <> raw) AS docs_modified,
sum(greatest(0, length(raw) - length(c)))::BIGINT AS chars_removed, sum(length(raw) - {_gone('raw', _NOISE)})::BIGINT AS zero_width_removed FROM normal""")
def normalize_stats(d: DataFrame) -> DataFrame:
    return cleaning.normalize_stats(d)


@query("t01_html_unescape", "documents")
def html_unescape(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.unescape(_text()).alias("text"), (T.unescape(_text()) != _text()).alias("changed"))


@query("t02_nfc", "documents", sql=f"SELECT doc_id, nfc_normalize({_D}) AS text FROM documents")
def nfc(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.nfc(_text()).alias("text"))


@query("t08_words", "documents", sql=f"SELECT doc_id, len({_words(_D)}) AS n_words, length({_ws(_words(_D))}) AS n_chars FROM documents")
def words(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.n_words(_text()).cast("long").alias("n_words"), T.word_chars(_text()).cast("long").alias("n_chars"))


@query("t09_latin_ratio", "documents", sql=f"SELECT doc_id, {_gone(_D, '[^\\p{L}]')} AS n_letters, {_gone(_D, '[^A-Za-z]')} AS n_latin FROM documents")
def latin_ratio(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.letters(_text()).cast("long").alias("n_letters"), T.latin_letters(_text()).cast("long").alias("n_latin"))


_KN_MARKS = "[\\x{c81}-\\x{c83}\\x{cbc}\\x{cbe}-\\x{ccd}\\x{cd5}-\\x{cd6}\\x{ce2}-\\x{cef}\\x{cf3}]"


@query("t10_kannada", "documents", sql=f"SELECT doc_id, k AS n_kannada, n AS n_letters, (n > 0 AND 2 * k >= n) AS is_kannada FROM (SELECT doc_id, len({_all(_D, '[\\x{c80}-\\x{cff}]')}) - len({_all(_D, _KN_MARKS)}) AS k, {_gone(_D, '[^\\p{L}]')} AS n FROM documents)")
def kannada(d: DataFrame) -> DataFrame:
    k, n = T.kannada_letters(_text()), T.letters(_text())
    return d.select("doc_id", k.cast("long").alias("n_kannada"), n.cast("long").alias("n_letters"), ((n > 0) & (2 * k >= n)).alias("is_kannada"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.ENGLISH) + "]"
_ascii = _all(f"lower({_D})", "[a-z'']+")
_ENGLISH = f"""counted AS (SELECT *, {_gone(_D, '[^\\p{L}]')} AS n, {_gone(_D, '[^A-Za-z]')} AS la, len({_ascii}) AS w, len(list_filter({_ascii}, lambda x: list_contains({_STOP}, x))) AS st FROM documents),
spoken AS (SELECT *, n > 0 AND w > 0 AND la::DOUBLE / n >= 0.7 AND st::DOUBLE / w >= 0.04 AS english FROM counted)"""


@query("t11_stopword_counts", "documents", sql=f"WITH {_ENGLISH} SELECT doc_id, w AS n_words, st AS n_stop FROM counted")
def stopwords(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.n_ascii_words(_text()).cast("long").alias("n_words"), T.english_hits(_text()).cast("long").alias("n_stop"))


@query("f01_language_filter", "documents", sql=f"WITH {_ENGLISH} SELECT lang, count(*) FILTER (WHERE english) AS kept, count(*) FILTER (WHERE NOT english) AS dropped FROM spoken GROUP BY lang")
def language_filter(d: DataFrame) -> DataFrame:
    kept = T.is_english(_text())
    return d.groupBy("lang").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


@query("t13_symbols", "documents", sql=f"SELECT doc_id, {_gone(_D, f'[\\p{{L}}\\p{{N}}{WS}\\x{{900}}-\\x{{d7f}}]')} AS n_symbols, {_gone(_D, f'[\\p{{L}}\\p{{N}}{WS}]')} AS n_symbols_plain, length({_D}) AS n_chars FROM documents")
def symbols(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.symbols(_text()).cast("long").alias("n_symbols"), T.symbols(_text(), False).cast("long").alias("n_symbols_plain"), F.length(_text()).cast("long").alias("n_chars"))


_canon = lambda x: f"lower(regexp_replace({_strip(x)}, '[{WS}]+', ' ', 'g'))"


@query("t14_canonical", "documents", sql=f"SELECT doc_id, {_canon(_D)} AS canonical FROM documents")
def canonical(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.canonical(_text()).alias("canonical"))


def _grams(w: str, k: int) -> str:
    return f"CASE WHEN len({w}) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(len({w}) - {k - 1}, 1) + 1), lambda i: array_to_string({w}[i:i+{k - 1}], ' '))) END"


@query("t15_shingles", "documents", sql=f"SELECT doc_id, len(g) AS n_shingles, md5(array_to_string(list_sort(g), '|')) AS digest FROM (SELECT doc_id, {_grams('w', 5)} AS g FROM (SELECT doc_id, {_words(_D)} AS w FROM documents))")
def shingles(d: DataFrame) -> DataFrame:
    made = d.select("doc_id", T.grams(T.words(_text()), 5).alias("g"))
    return made.select("doc_id", F.size("g").cast("long").alias("n_shingles"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("digest"))


_tokens = lambda x: _all(f"lower({x})", f"[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{WS}]")
_units = lambda x: _all(x, f"[{WS}]*[^{WS}]+|[{WS}]+$")


@query("t16_split_tokens", "documents", sql=f"SELECT doc_id, len({_tokens(_D)}) AS n_tokens, md5(array_to_string({_tokens(_D)}, ' ')) AS digest FROM documents")
def split_tokens(d: DataFrame) -> DataFrame:
    made = T.tokens(_text())
    return d.select("doc_id", F.size(made).cast("long").alias("n_tokens"), F.md5(F.array_join(made, " ")).alias("digest"))


@query("t17_units", "documents", sql=f"SELECT doc_id, len({_units(_D)}) AS n_units, array_to_string({_units(_D)}, '') = {_D} AS lossless FROM documents")
def units(d: DataFrame) -> DataFrame:
    made = T.units(_text())
    return d.select("doc_id", F.size(made).cast("long").alias("n_units"), (F.array_join(made, "") == _text()).alias("lossless"))


@query("t18_cap_words", "documents", sql=f"SELECT doc_id, array_to_string({_units(_D)}[1:50], '') AS capped FROM documents")
def cap_words(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.array_join(F.slice(T.units(_text()), 1, 50), "").alias("capped"))


_SCRIPT = "CASE WHEN f = '' THEN 'none' " + " ".join(f"WHEN regexp_matches(f, '\\p{{{s}}}') THEN '{s}'" for s in ("Latin", "Devanagari", "Kannada", "Telugu", "Cyrillic", "Greek")) + " ELSE 'other' END"


@query("t19_script", "documents", sql=f"SELECT script, count(*) AS n FROM (SELECT {_SCRIPT} AS script FROM (SELECT regexp_extract(w, '\\p{{L}}') AS f FROM (SELECT unnest({_words(_D)}) AS w FROM documents))) GROUP BY script")
def scripts(d: DataFrame) -> DataFrame:
    return d.select(F.explode(T.words(_text())).alias("w")).groupBy(T.script(F.col("w")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query("t20_token_bytes", "documents", sql=f"SELECT w AS token, octet_length(encode(w)) AS n_bytes, count(*) AS n FROM (SELECT unnest({_words(_D)}) AS w FROM documents) GROUP BY ALL")
def token_bytes(d: DataFrame) -> DataFrame:
    return d.select(F.explode(T.words(_text())).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", F.octet_length("token").cast("long").alias("n_bytes"), "n")


_HEUR = f"""counts AS (SELECT *, len(ws) AS n_words, length({_ws('ws')}) AS n_chars, len({_all(_D, T.SYMBOLS.replace("'", "''"))}) AS n_symbols, len(ls) AS n_lines,
 len(list_filter(ls, lambda s: regexp_matches({_strip('s')}, '[.!?"'']$'))) AS n_ended, len(list_distinct(list_transform(ls, lambda s: {_strip('s')}))) AS n_distinct,
 len(list_distinct(list_filter(list_transform(ws, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')), lambda w: list_contains({[*T.COMMON]}, w)))) AS n_common,
 len(list_filter(ls, lambda s: regexp_matches({_strip('s')}, '^[-*\\x{{2022}}]'))) AS n_bullets, len(list_filter(ls, lambda s: regexp_matches({_strip('s')}, '(?:\\.\\.\\.|\\x{{2026}})$'))) AS n_dotted
 FROM (SELECT * EXCLUDE (n_chars), n_chars AS stored, {_words(_D)} AS ws, {_lines(_D)} AS ls FROM documents)),
ruled AS (SELECT *, n_words BETWEEN 50 AND 100000 AND n_chars >= 3 * n_words AND n_chars <= 10 * n_words AND n_symbols * 10 < n_words AND n_ended * 10 >= 3 * n_lines
 AND (n_lines - n_distinct) * 10 < 3 * n_lines AND n_common >= 2 AND n_bullets * 10 < 9 * n_lines AND n_dotted * 10 < 3 * n_lines AS passed FROM counts)"""
_HEUR_COLS = "n_words, n_chars, n_symbols, n_lines, n_ended, n_distinct, n_common, n_bullets, n_dotted"


@query("t21_gopher_rules", "documents", sql=f"WITH {_HEUR} SELECT doc_id, {_HEUR_COLS}, passed FROM ruled")
def web_rules(d: DataFrame) -> DataFrame:
    made = d.select("doc_id", *(c.cast("long").alias(n) for n, c in T.heuristics(_text()).items()))
    return made.withColumn("passed", T.passes())


@query("t21_top_bigram", "documents", sql=f"""SELECT doc_id, max(n) AS top, sum(n)::BIGINT AS total FROM (SELECT doc_id, b, count(*) AS n FROM
(SELECT doc_id, unnest(list_transform(range(1, length({_D})), lambda i: substr({_D}, i, 2))) AS b FROM documents) GROUP BY ALL) GROUP BY doc_id""")
def top_bigram(d: DataFrame) -> DataFrame:
    return cleaning.top_bigram(d)


@query("t22_rule_and_score_gate", "documents", sql=f"WITH {_HEUR} SELECT source, count(*) AS n, count(*) FILTER (WHERE passed) AS by_rules, count(*) FILTER (WHERE passed AND coalesce(stored, 0) >= 1000) AS kept FROM ruled GROUP BY source")
def rule_and_score_gate(d: DataFrame) -> DataFrame:
    made = d.select("source", F.col("n_chars").alias("score"), *(c.cast("long").alias(n) for n, c in T.heuristics(_text()).items())).withColumn("passed", T.passes())
    kept = F.col("passed") & (F.coalesce("score", F.lit(0)) >= 1000)
    return made.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("by_rules"), F.count_if(kept).alias("kept"))


_ROLE = "^(user|plan|tool_call|observation|response): (.*)$"
_TURNS = f"""turns AS (SELECT doc_id, i, regexp_extract(l, '{_ROLE}', 1) AS role, regexp_extract(l, '{_ROLE}', 2) AS said FROM
(SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split({_D}, chr(10)) AS ls FROM documents)) WHERE regexp_matches(l, '{_ROLE}'))"""


@query("t23_unify_conversation", "documents", sql=f"WITH {_TURNS} SELECT doc_id, string_agg('<|' || role || '|>' || said, '' ORDER BY i) || '<|end|>' AS rendered, count(*) AS n_turns FROM turns GROUP BY doc_id")
def unify_conversation(d: DataFrame) -> DataFrame:
    return cleaning.conversations(d)


def _unify(x: str) -> str:
    for pattern, to in cleaning.UNIFIED:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


_MARKERS = {name: f"len(regexp_extract_all({_D}, '{pattern}'))" for name, pattern in cleaning.DIALECTS}


@query("t23_dialects", "documents", sql=f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} > 0 THEN '{n}' END" for n, c in _MARKERS.items())}], lambda x: x IS NOT NULL), ',') AS dialects, {' + '.join(_MARKERS.values())} AS n_markers,
CASE WHEN {' + '.join(_MARKERS.values())} > 0 THEN {_unify(_D)} || '<|end|>' ELSE {_D} END AS unified FROM documents""")
def dialects(d: DataFrame) -> DataFrame:
    return cleaning.unified_dialects(d)


@query("t24_subwords", "documents", sql=f"""SELECT doc_id, sum(CASE WHEN regexp_matches(w, '^[A-Za-z]+$') AND length(w) > 4 THEN ceil(length(w) / 4.0) WHEN regexp_matches(w, '^[\\x{{900}}-\\x{{97f}}]+$') AND length(w) > 3 THEN 2 ELSE 1 END)::BIGINT AS n_subwords, count(*) AS n_words
FROM (SELECT doc_id, unnest({_words(_D)}) AS w FROM documents) GROUP BY doc_id""")
def subwords(d: DataFrame) -> DataFrame:
    made = d.select("doc_id", T.words(_text()).alias("w")).where(F.size("w") > 0)
    return made.select("doc_id", F.aggregate("w", F.lit(0), lambda a, w: a + F.size(T.subwords(w))).cast("long").alias("n_subwords"), F.size("w").cast("long").alias("n_words"))


@query("t25_ghost_tags", "documents", sql=f"SELECT doc_id, len({_all(_D, '\\|?<?\\[?/?(?:INST|user|assistant|system)\\]?\\|?>?')}) AS n_markers, len({_all(_D, '<\\|[a-z]+\\|>')}) AS n_unified FROM documents")
def ghost_tags(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.size(T.matches(_text(), r"\|?<?\[?/?(?:INST|user|assistant|system)\]?\|?>?")).cast("long").alias("n_markers"), F.size(T.matches(_text(), r"<\|[a-z]+\|>")).cast("long").alias("n_unified"))


@query("t26_token_counts", "documents", sql=f"SELECT doc_id, len({_all(_D, f'[\\p{{L}}\\p{{N}}]+|[^{WS}\\p{{L}}\\p{{N}}]')}) AS n_simple, len({_all(_D, f'[A-Za-z]+|[0-9]+|[^{WS}A-Za-z0-9]')}) AS n_effort FROM documents")
def token_counts(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.simple_tokens(_text()).cast("long").alias("n_simple"), T.effort_tokens(_text()).cast("long").alias("n_effort"))


@query("t28_windows", "documents")
def windows(d: DataFrame) -> DataFrame:
    return cleaning.windows(d)


@query("t29_diff_samples", "documents", sql=f"WITH {_NORMAL} SELECT doc_id, substr(raw, 1, 400) AS before, substr(c, 1, 400) AS after FROM normal WHERE c <> raw ORDER BY doc_id LIMIT 20")
def diff_samples(d: DataFrame) -> DataFrame:
    made, _ = T.normalized(_text())
    return d.select("doc_id", _text().alias("raw"), made.alias("c")).where("c <> raw").orderBy("doc_id").limit(20).select("doc_id", F.substring("raw", 1, 400).alias("before"), F.substring("c", 1, 400).alias("after"))


_QUALITY = f"""flags AS (SELECT *, length(raw) < 200 AS too_short, {_gone('raw', f'[\\p{{L}}\\p{{N}}{WS}\\x{{900}}-\\x{{d7f}}]')}::DOUBLE / greatest(length(raw), 1) > 0.25 AS too_many_symbols,
 len(ls) > 0 AND len(list_filter(ls, lambda l: regexp_matches(l, '^.+\\|.+\\|.+')))::DOUBLE / len(ls) > 0.5 AS boilerplate, len(ls) > 0 AND (len(ls) - len(list_distinct(ls)))::DOUBLE / len(ls) > 0.3 AS dup_lines,
 len(ws) > 0 AND (length({_ws('ws')})::DOUBLE / len(ws) < 1.2 OR length({_ws('ws')})::DOUBLE / len(ws) > 40) AS word_len FROM (SELECT *, {_D} AS raw, {_words(_D)} AS ws, {_lines(_D)} AS ls FROM documents))"""


@query("f02_quality_reasons", "documents", sql=f"""WITH {_QUALITY} SELECT doc_id, array_to_string(list_filter([CASE WHEN too_short THEN 'too_short' END, CASE WHEN too_many_symbols THEN 'too_many_symbols' END,
CASE WHEN boilerplate THEN 'boilerplate' END, CASE WHEN dup_lines THEN 'dup_lines' END, CASE WHEN word_len THEN 'word_len' END], lambda x: x IS NOT NULL), ',') AS reasons FROM flags""")
def quality_reasons(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.array_join(T.quality_reasons(_text()), ",").alias("reasons"))


@query("f04_duplicate_lines", "documents", sql=f"SELECT doc_id, len(ls) AS n_lines, len(list_distinct(ls)) AS n_distinct, len(list_filter(ls, lambda l: regexp_matches(l, '^.+\\|.+\\|.+'))) AS n_nav FROM (SELECT doc_id, {_lines(_D)} AS ls FROM documents)")
def duplicate_lines(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.size(T.lines(_text())).cast("long").alias("n_lines"), F.size(F.array_distinct(T.lines(_text()))).cast("long").alias("n_distinct"), T.nav_lines(_text()).cast("long").alias("n_nav"))


@query("f06_canary", "documents", sql=f"SELECT source, count(*) FILTER (WHERE contains({_D}, 'enable JavaScript')) AS n_hit, count(*) AS n FROM documents GROUP BY source")
def canary(d: DataFrame) -> DataFrame:
    return cleaning.marked(d, "enable JavaScript").groupBy("source").agg(F.count_if("marked").alias("n_hit"), F.count(F.lit(1)).alias("n"))


_MAIL, _IP = "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+", "\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b"


@query("f10_dirt_probes", "run_pipeline", sql=f"""SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches({_D}, '{_MAIL}')) AS email, count(*) FILTER (WHERE contains({_D}, '|')) AS pipe, count(*) FILTER (WHERE length({_D}) < 200) AS tiny,
count(*) FILTER (WHERE regexp_matches({_D}, '{_NOISE}')) AS zero_width, count(*) FILTER (WHERE regexp_matches({_D}, '&[a-z]+;')) AS entity FROM run_pipeline""")
def dirt_probes(d: DataFrame) -> DataFrame:
    return cleaning.probes(d)


_URL = "https?://[^" + WS + "]+"
_MASK = f"""m1 AS (SELECT *, regexp_replace(raw, '{_URL}', '[URL]', 'g') AS a, len({_all('raw', _URL)}) AS n_url FROM (SELECT *, {_D} AS raw FROM run_pipeline)),
m2 AS (SELECT *, regexp_replace(a, '{_MAIL}', '[EMAIL]', 'g') AS b, len({_all('a', _MAIL)}) AS n_email FROM m1), m3 AS (SELECT *, regexp_replace(b, '{_IP}', '[IP]', 'g') AS c, len({_all('b', _IP)}) AS n_ip FROM m2)"""


@query("pii_mask_email_ip", "run_pipeline", sql=f"WITH {_MASK} SELECT doc_id, c AS masked, n_url, n_email, n_ip FROM m3")
def mask_simple(d: DataFrame) -> DataFrame:
    made, counts = masking.structured(_text(), phones=False)
    return d.select("doc_id", made.alias("masked"), *(c.cast("long").alias(f"n_{k}") for k, c in counts.items()))


@query("pii_mask_full", "run_pipeline")
def mask_full(d: DataFrame) -> DataFrame:
    made, counts = masking.structured(_text())
    return d.select("doc_id", made.alias("masked"), *(c.cast("long").alias(f"n_{k}") for k, c in counts.items()))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@query("pii_strict_kinds", "run_pipeline", sql=f"""SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN regexp_matches(w, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}$') THEN 'email'
WHEN regexp_matches(w, '^{_OCTET}(?:\\.{_OCTET}){{3}}$') THEN 'ip' WHEN regexp_matches(w, '^\\+?[0-9][0-9().-]+[0-9]$') AND length(regexp_replace(w, '[^0-9]', '', 'g')) BETWEEN 9 AND 13 THEN 'phone' END AS kind
FROM (SELECT doc_id, unnest({_words(_D)}) AS w FROM run_pipeline)) WHERE kind IS NOT NULL GROUP BY ALL""")
def strict_kinds(d: DataFrame) -> DataFrame:
    rows = d.select("doc_id", F.explode(T.words(_text())).alias("w")).select("doc_id", masking.strict_kind(F.col("w")).alias("kind"))
    return rows.where("kind is not null").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("pii_totals", "run_pipeline", sql=f"WITH {_MASK} SELECT 'url' AS kind, sum(n_url)::BIGINT AS n FROM m3 UNION ALL SELECT 'email', sum(n_email)::BIGINT FROM m3 UNION ALL SELECT 'ip', sum(n_ip)::BIGINT FROM m3")
def mask_totals(d: DataFrame) -> DataFrame:
    return masking.totals(d)


@query("pii_recorded_kinds", "manifest", sql="SELECT pii_screen_status AS status, k AS kind, sum(pii_counts[k])::BIGINT AS n FROM (SELECT pii_screen_status, pii_counts, unnest(map_keys(pii_counts)) AS k FROM manifest) GROUP BY ALL")
def recorded_kinds(m: DataFrame) -> DataFrame:
    return m.select(F.col("pii_screen_status").alias("status"), F.explode("pii_counts").alias("kind", "v")).groupBy("status", "kind").agg(F.sum("v").alias("n"))


@query("f13_screen_precision", "manifest", "run_pipeline", sql=f"""WITH {_MASK}, per AS (SELECT doc_id, max(n_email) > 0 AS has FROM m3 GROUP BY doc_id),
told AS (SELECT doc_ids[1] AS doc_id, coalesce(pii_counts['email'], 0) > 0 AS said FROM manifest)
SELECT count(*) FILTER (WHERE said AND has) AS tp, count(*) FILTER (WHERE said AND NOT has) AS fp, count(*) FILTER (WHERE NOT said AND has) AS fn FROM told JOIN per USING (doc_id)""")
def screen_precision(m: DataFrame, d: DataFrame) -> DataFrame:
    return masking.precision(m, d)


@query("a01_stage_funnel", "documents", sql=f"""WITH {_QUALITY}, counted AS (SELECT *, {_gone('raw', '[^\\p{L}]')} AS n, {_gone('raw', '[^A-Za-z]')} AS la, len({_all("lower(raw)", "[a-z'']+")}) AS w,
 len(list_filter({_all("lower(raw)", "[a-z'']+")}, lambda x: list_contains({_STOP}, x))) AS st FROM flags),
passed AS (SELECT len(ws) AS t, n > 0 AND w > 0 AND la::DOUBLE / n >= 0.7 AND st::DOUBLE / w >= 0.04 AS p1, NOT (too_short OR too_many_symbols OR boilerplate OR dup_lines OR word_len) AS p2, row_number() OVER (PARTITION BY md5(raw) ORDER BY doc_id) = 1 AS p3 FROM counted)
SELECT 'load' AS stage, count(*) AS docs, sum(t)::BIGINT AS tokens FROM passed UNION ALL SELECT 'langid', count(*), sum(t)::BIGINT FROM passed WHERE p1
UNION ALL SELECT 'quality', count(*), sum(t)::BIGINT FROM passed WHERE p1 AND p2 UNION ALL SELECT 'exact_dedup', count(*), sum(t)::BIGINT FROM passed WHERE p1 AND p2 AND p3""")
def stage_funnel(d: DataFrame) -> DataFrame:
    return cleaning.funnel(d)


@query("plan_cleaned", "run_pipeline", "benchmark")
def cleaned(d: DataFrame, b: DataFrame) -> DataFrame:
    """The corpus that the whole cleaning run leaves."""
    return clean(d, b)[0]


@query("plan_cleaning_report", "run_pipeline", "benchmark")
def cleaning_report(d: DataFrame, b: DataFrame) -> DataFrame:
    """Documents and words left by each stage of the cleaning run."""
    return clean(d, b)[1]


@query("a03_total_reduction", "run_pipeline", "benchmark")
def total_reduction(d: DataFrame, b: DataFrame) -> DataFrame:
    """How much of the words the cleaning run takes away, in hundredths of a percent."""
    left = F.max(F.when(F.col("stage") == "decontaminate", F.col("tokens")))
    had = F.max(F.when(F.col("stage") == "normalize", F.col("tokens")))
    return clean(d, b)[1].agg(had.alias("before"), left.alias("after"), F.floor(10_000 * (had - left) / F.greatest(had, F.lit(1))).alias("reduced_10k"))


@query("a02_fertility", "documents", sql=f"SELECT lang, sum(len({_tokens(_D)}))::BIGINT AS tokens, sum(len({_words(_D)}))::BIGINT AS words FROM documents GROUP BY lang")
def fertility(d: DataFrame) -> DataFrame:
    return d.groupBy("lang").agg(F.sum(F.size(T.tokens(_text()))).alias("tokens"), F.sum(T.n_words(_text())).alias("words"))


@query("a14_fertility_spread", "documents", sql=f"SELECT max(f) - min(f) AS spread_millis FROM (SELECT (1000 * sum(len({_tokens(_D)}))::BIGINT) // greatest(sum(len({_words(_D)}))::BIGINT, 1) AS f FROM documents GROUP BY lang)")
def fertility_spread(d: DataFrame) -> DataFrame:
    per = fertility(d).select(F.floor(1000 * F.col("tokens") / F.greatest("words", F.lit(1))).alias("f"))
    return per.agg((F.max("f") - F.min("f")).alias("spread_millis"))


@query("a20_language_shares", "documents", sql="SELECT source, string_agg(l || ':' || n, ',' ORDER BY l) AS languages FROM (SELECT source, coalesce(lower(lang), 'none') AS l, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def language_shares(d: DataFrame) -> DataFrame:
    per = d.groupBy("source", F.coalesce(F.lower("lang"), F.lit("none")).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l", "n"))), lambda x: F.concat_ws(":", x["l"], x["n"].cast("string")))
    return per.groupBy("source").agg(F.array_join(listed, ",").alias("languages"))


@query("a21_kept_by_threshold", "manifest", sql="SELECT t AS threshold, count(*) FILTER (WHERE admission_score >= t) AS kept, count(*) AS n FROM manifest, range(0, 101, 10) r(t) GROUP BY t")
def kept_by_threshold(m: DataFrame) -> DataFrame:
    level = F.least(F.floor(F.col("admission_score") / 10), F.lit(10)).alias("level")
    per = m.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    steps = m.sparkSession.range(0, 101, 10).toDF("threshold")
    total = per.agg(F.sum("n").alias("n"))
    kept = steps.join(F.broadcast(per.withColumnRenamed("n", "k")), F.col("level") * 10 >= F.col("threshold"), "left").groupBy("threshold").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("kept"))
    return kept.join(F.broadcast(total))


@query("w02_token_budget_prefix", "documents", sql=f"SELECT doc_id, before AS running FROM (SELECT doc_id, coalesce(sum(len({_words(_D)})) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents) WHERE before < 50000")
def token_budget(d: DataFrame) -> DataFrame:
    return cleaning.budget_prefix(d.select("doc_id", F.size(T.words(_text())).alias("n")), "doc_id", "n", 50_000)


@query("w01_row_ids", "documents", sql=f"SELECT doc_id, 'doc-' || (row_number() OVER (ORDER BY doc_id) - 1) AS name FROM documents WHERE length({_strip(_D)}) > 0")
def row_ids(d: DataFrame) -> DataFrame:
    return cleaning.numbered(d.where(F.length(T.strip(_text())) > 0).select("doc_id"), "doc_id").select("doc_id", F.concat(F.lit("doc-"), F.col("row")).alias("name"))


@query("w12_sample", "documents")
def sample(d: DataFrame) -> DataFrame:
    return cleaning.seeded_sample(d, "doc_id", 50, 1234)


@query("k01_vocabulary", "documents", sql=f"SELECT token, row_number() OVER (ORDER BY encode(token)) + 3 AS id FROM (SELECT DISTINCT unnest({_tokens(_D)}) AS token FROM documents)")
def build_vocabulary(d: DataFrame) -> DataFrame:
    return vocabulary.vocabulary(d)


_VOCAB = f"vocab AS (SELECT token, row_number() OVER (ORDER BY encode(token)) + 3 AS id FROM (SELECT DISTINCT unnest({_tokens(_D)}) AS token FROM documents))"


@query("k02_encode", "benchmark", "documents", sql=f"""WITH {_VOCAB}, said AS (SELECT item_id, generate_subscripts(ts, 1) AS i, unnest(ts) AS token FROM (SELECT item_id, {_tokens(_D)} AS ts FROM benchmark))
SELECT item_id, string_agg(coalesce(id, 3), ' ' ORDER BY i) AS ids FROM said LEFT JOIN vocab USING (token) GROUP BY item_id""")
def encode(b: DataFrame, d: DataFrame) -> DataFrame:
    return vocabulary.encoded(b, vocabulary.vocabulary(d), "item_id").select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("k07_round_trip", "documents", sql=f"SELECT doc_id, true AS same FROM documents WHERE len({_tokens(_D)}) > 0")
def round_trip(d: DataFrame) -> DataFrame:
    vocab = vocabulary.vocabulary(d)
    back = vocabulary.decoded(vocabulary.encoded(d, vocab, "doc_id"), vocab, "doc_id")
    want = d.select("doc_id", F.array_join(T.tokens(_text()), " ").alias("want"))
    return back.join(want, "doc_id").select("doc_id", (F.col("text") == F.col("want")).alias("same"))


@query("a11_unit_counts", "documents", sql=f"SELECT lang, unit, count(*) AS n FROM (SELECT lang, unnest({_units(_D)}) AS unit FROM documents) GROUP BY ALL")
def unit_counts(d: DataFrame) -> DataFrame:
    return vocabulary.unit_counts(d)


@query("a12_pair_counts", "documents", sql=f"""WITH u AS (SELECT lang, unit, count(*) AS n FROM (SELECT lang, unnest({_units(_D)}) AS unit FROM documents) GROUP BY ALL)
SELECT lang, pair[1:1] AS a, pair[2:2] AS b, sum(n)::BIGINT AS n FROM (SELECT lang, n, unnest(list_transform(range(1, length(unit)), lambda i: substr(unit, i, 2))) AS pair FROM u) GROUP BY lang, pair""")
def pair_counts(d: DataFrame) -> DataFrame:
    return vocabulary.pair_counts(vocabulary.unit_counts(d))


@query("k03_bpe_train", "documents")
def bpe_train(d: DataFrame) -> DataFrame:
    model = vocabulary.train(vocabulary.unit_counts(d.withColumn("lang", F.coalesce(F.lower(F.trim("lang")), F.lit("none")))), merges=200)
    return d.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(model.merges)], "rank int, a string, b string")


@query("k06_bpe_encode", "documents")
def bpe_encode(d: DataFrame) -> DataFrame:
    model = vocabulary.train(vocabulary.unit_counts(d.withColumn("lang", F.coalesce(F.lower(F.trim("lang")), F.lit("none")))), merges=200)
    return vocabulary.bpe_encoded(d, model, "doc_id")


@query("io13_vocabulary_kinds", "documents", sql=f"WITH {_VOCAB} SELECT CASE WHEN id < 4 THEN 'special' WHEN length(token) = 1 THEN 'base' ELSE 'merge' END AS kind, count(*) AS n FROM vocab GROUP BY 1")
def vocabulary_kinds(d: DataFrame) -> DataFrame:
    kind = F.when(F.col("id") < 4, "special").when(F.length("token") == 1, "base").otherwise("merge")
    return vocabulary.vocabulary(d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
