"""Token streams, packed samples with masks, their ledger events, replay and verification.

A document is read line by line: a line that names a role is a turn of that role, any other
is plain text. Turns of ``LOSS_ROLES`` and plain text bear loss, other turns do not, nor
does the end mark that closes each stream. Samples are windows of ``size`` tokens over the
streams laid end to end in order of ids; each holds the fragments of one or more documents,
numbered as segments, with positions that start again at each, and padding as a segment of
its own. A null or empty text has no stream; columns not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import hashing as H
from lodeworks.functions import text as T
from lodeworks.operators.cleaning import ROLE, running

# Roles whose tokens bear loss; ids of padding and of the end mark; ids below it are special.
LOSS_ROLES = ("plan", "tool_call", "response")
PAD, EOS, SPECIALS = 0, 2, 4
WINDOW = 128
#: What may be wrong with a sample, in the order in which it is looked for.
VIOLATIONS = ("ragged_arrays", "wrong_seq_len", "loss_mask_hash_mismatch", "padding_is_loss_bearing", "segment_ids_not_monotonic", "position_ids_not_reset_per_document", "token_span_length_mismatch")


def token_id(token: Column) -> Column:
    """A token's number, the same in every table: 24 bits of md5 after the special ids."""
    return F.conv(F.substring(F.md5(token), 1, 6), 16, 10).cast("long") + SPECIALS


def streams(d: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``tokens`` and ``mask`` of every document that has tokens, the end mark included; ``id`` as text."""

    def part(line: Column) -> Column:
        turn = line.rlike(ROLE)
        said = F.when(turn, F.regexp_extract(line, ROLE, 2)).otherwise(line)
        bears = ~turn | F.regexp_extract(line, ROLE, 1).isin(*LOSS_ROLES)
        return F.struct(T.tokens(said).alias("tokens"), bears.cast("int").alias("bears"))

    parts = d.select(F.col(id).cast("string").alias("id"), F.col(id).alias("key"), F.transform(F.split(T.text_of(text), "\n"), part).alias("parts"))
    tokens = F.transform(F.flatten(F.transform("parts", lambda p: p["tokens"])), token_id)
    mask = F.flatten(F.transform("parts", lambda p: F.array_repeat(p["bears"], F.size(p["tokens"]))))
    rows = parts.select("id", "key", tokens.alias("tokens"), mask.alias("mask")).where(F.size("tokens") > 0)
    return rows.select("id", "key", F.concat("tokens", F.array(F.lit(EOS).cast("long"))).alias("tokens"), F.concat("mask", F.array(F.lit(0))).alias("mask"))


def fragments(made: DataFrame, size: int = WINDOW) -> DataFrame:
    """``bin``, ``id``, ``key``, ``start``, ``stop``: the parts of each stream that fall in each window."""
    spots = running(made.select("key", F.size("tokens").alias("n")), "key", "n")
    at, n = F.col("before"), F.col("n")
    bins = spots.withColumn("bin", F.explode(F.sequence(F.floor(at / size), F.floor((at + n - 1) / size))))
    cut = bins.select("bin", "key", (F.greatest(at, F.col("bin") * size) - at).alias("start"), (F.least(at + n, (F.col("bin") + 1) * size) - at).alias("stop"))
    return cut.withColumn("id", F.col("key").cast("string"))


def assembled(parts: DataFrame, by: str, size: int = WINDOW) -> DataFrame:
    """Samples from rows of ``by``, ``i``, ``id``, ``start``, ``stop``, ``tokens``, ``mask``, in order of ``i``."""
    row = F.struct("i", "id", "start", "stop", "tokens", "mask")
    per = parts.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("docs"))
    length = lambda x: (x["stop"] - x["start"]).cast("int")
    used = F.aggregate("docs", F.lit(0), lambda a, x: a + length(x))
    per = per.withColumn("pad", F.greatest(F.lit(size) - used, F.lit(0)))
    padded = lambda filled, value: F.slice(F.concat(filled, F.array_repeat(value, F.col("pad"))), 1, size)
    made = per.select(
        by,
        F.transform("docs", lambda x: x["id"]).alias("shard_ids"),
        F.transform("docs", lambda x: F.concat_ws(":", x["id"], x["start"].cast("string"), x["stop"].cast("string"))).alias("token_span_ids"),
        F.lit(size).alias("seq_len"),
        padded(F.flatten(F.transform("docs", lambda x: x["tokens"])), F.lit(PAD).cast("long")).alias("tokens"),
        padded(F.flatten(F.transform("docs", lambda x: F.sequence(F.lit(0), length(x) - 1))), F.lit(0)).alias("position_ids"),
        padded(F.flatten(F.transform("docs", lambda x, i: F.array_repeat(i.cast("int"), length(x)))), F.size("docs")).alias("segment_ids"),
        padded(F.flatten(F.transform("docs", lambda x: x["mask"])), F.lit(0)).alias("loss_mask"),
    )
    return made.withColumn("loss_mask_hash", H.mask_hash(F.col("loss_mask")))


def _sliced(spans: DataFrame, made: DataFrame) -> DataFrame:
    """Spans with the tokens and mask that they cut from the streams."""
    first, length = (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")
    cut = lambda c: F.slice(c, first, F.greatest(length, F.lit(0))).alias(c)
    return spans.join(made.select("id", "tokens", "mask"), "id").select(*spans.columns, cut("tokens"), cut("mask"))


def samples(d: DataFrame, size: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every window of the table as a sample, numbered by ``ledger_offset``."""
    made = streams(d, id, text)
    cut = fragments(made, size).select(F.col("bin").alias("ledger_offset"), F.col("key").alias("i"), "id", "start", "stop")
    return assembled(_sliced(cut, made), "ledger_offset", size)


def committed(packed: DataFrame, branch: str = "run-a") -> DataFrame:
    """Ledger events of samples: what a run writes down, without the tokens."""
    return packed.select(F.lit("batch_committed").alias("event"), "ledger_offset", F.lit(branch).alias("run_branch_id"), "shard_ids", "token_span_ids", "seq_len", "loss_mask_hash")


def replayed(events: DataFrame, made: DataFrame, size: int = WINDOW) -> DataFrame:
    """Samples rebuilt from the spans of events alone and from the streams; ``made`` as ``streams`` gives them.

    A span of a document that is not there leaves its sample without that fragment.
    """
    spans = events.select("ledger_offset", F.posexplode("token_span_ids").alias("i", "span"))
    told = F.regexp_extract("span", "^(.*):[0-9]+:[0-9]+$", 1)
    number = lambda g: F.regexp_extract("span", "^.*:([0-9]+):([0-9]+)$", g).cast("long")
    return assembled(_sliced(spans.select("ledger_offset", "i", told.alias("id"), number(1).alias("start"), number(2).alias("stop")), made), "ledger_offset", size)


def compared(events: DataFrame, rebuilt: DataFrame, shift: int = 0) -> DataFrame:
    """Per event whether the sample rebuilt for the offset ``shift`` further on is the one written down."""
    theirs = rebuilt.select((F.col("ledger_offset") - shift).alias("ledger_offset"), F.col("loss_mask_hash").alias("hash"), F.col("shard_ids").alias("ids"), F.col("token_span_ids").alias("spans"))
    same = F.col("hash").eqNullSafe(F.col("loss_mask_hash")) & F.col("ids").eqNullSafe(F.col("shard_ids")) & F.col("spans").eqNullSafe(F.col("token_span_ids"))
    return events.join(theirs, "ledger_offset", "left").select("ledger_offset", F.col("loss_mask_hash").alias("original"), F.col("hash").alias("rebuilt"), same.alias("matched"))


def attended(segments: Column) -> Column:
    """How many pairs of positions j <= i of one segment a sample has, from its segment ids."""
    at = F.transform(segments, lambda s: s)
    runs = F.aggregate(
        at,
        F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("pairs")),
        lambda a, s: F.struct(s.alias("last"), F.when(a["last"] == s, a["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), (a["pairs"] + F.when(a["last"] == s, a["run"] + 1).otherwise(F.lit(1).cast("long"))).alias("pairs")),
    )
    return runs["pairs"]


def violations(packed: DataFrame) -> DataFrame:
    """``ledger_offset`` and ``violations``, all that is wrong with each sample's own arrays."""
    n = F.size("tokens")
    ragged = (F.size("position_ids") != n) | (F.size("segment_ids") != n) | (F.size("loss_mask") != n)
    paid = F.exists(F.arrays_zip("tokens", "loss_mask"), lambda x: (x["tokens"] == PAD) & (x["loss_mask"] != 0))
    documents = F.size("shard_ids")
    seen = F.arrays_zip("segment_ids", "position_ids")
    walk = F.aggregate(
        seen,
        F.struct(F.lit(-1).alias("segment"), F.lit(0).alias("next"), F.lit(True).alias("ok")),
        lambda a, x: F.struct(
            x["segment_ids"].alias("segment"),
            (F.when(a["segment"] == x["segment_ids"], a["next"]).otherwise(0) + 1).alias("next"),
            (a["ok"] & ((x["segment_ids"] >= documents) | (x["position_ids"] == F.when(a["segment"] == x["segment_ids"], a["next"]).otherwise(0)))).alias("ok"),
        ),
    )
    spans = F.transform("token_span_ids", lambda s: (F.regexp_extract(s, ":([0-9]+)$", 1).cast("int") - F.regexp_extract(s, ":([0-9]+):[0-9]+$", 1).cast("int")))
    runs = F.transform(F.sequence(F.lit(0), documents - 1), lambda k: F.size(F.filter("segment_ids", lambda s: s == k.cast("int"))))
    checks = (
        ragged, n != F.col("seq_len"), H.mask_hash(F.col("loss_mask")) != F.col("loss_mask_hash"), paid,
        F.array_sort("segment_ids") != F.col("segment_ids"), ~walk["ok"], spans != runs,
    )
    found = F.array_compact(F.array(*(F.when(c, F.lit(v)) for c, v in zip(checks, VIOLATIONS, strict=True))))
    return packed.select("ledger_offset", found.alias("violations"))


def microbatches(packed: DataFrame, size: int = 4) -> DataFrame:
    """Samples by fours, each field a list in order of the offsets."""
    fields = ("shard_ids", "tokens", "position_ids", "segment_ids", "loss_mask")
    rows = packed.groupBy(F.floor(F.col("ledger_offset") / size).alias("microbatch")).agg(F.array_sort(F.collect_list(F.struct("ledger_offset", *fields))).alias("rows"))
    listed = lambda f: F.transform("rows", lambda r: r[f]).alias(f)
    return rows.select("microbatch", *map(listed, fields))


def shards(d: DataFrame, lane: Column | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``shard_id``, ``content_hash``, ``token_count``: a shard per stream, named by its content."""
    made = streams(d, id, text)
    own = F.slice("tokens", 1, F.size("tokens") - 1)
    lanes = d.select(F.col(id).cast("string").alias("id"), (F.coalesce("lane", F.lit("none")) if lane is None else lane).alias("lane"))
    rows = made.select("id", H.ids_hash(own).alias("content_hash"), (F.size("tokens") - 1).cast("long").alias("token_count")).join(lanes, "id")
    return rows.select("id", F.concat_ws("-", "lane", F.substring("content_hash", 1, 12)).alias("shard_id"), "content_hash", "token_count")
