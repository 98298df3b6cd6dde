"""Hashes, fingerprints and signatures as column expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.functions.text import let

PRIME = 2147483647
HASHES, BANDS = 128, 32


def coefficients(n: int = HASHES, seed: int = 42) -> list[tuple[int, int]]:
    """Seeded factors and summands of the permutations."""
    gen = random.Random(seed)
    return [(gen.randrange(1, PRIME), gen.randrange(PRIME)) for _ in range(n)]


def short_hash(text: Column) -> Column:
    """A 31-bit hash that other engines can repeat: the start of md5 modulo a prime."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % PRIME


def long_hash(text: Column) -> Column:
    """A 60-bit fingerprint: the start of md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def signature(hashes: Column, pairs: list[tuple[int, int]] | None = None) -> Column:
    """MinHash values of a set of hashes; of an empty set, the prime throughout."""
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (pairs or coefficients())))
    least = lambda hs, c: F.array_min(F.transform(hs, lambda h: (c["a"] * h + c["b"]) % PRIME))
    return let(hashes, lambda hs: F.transform(table, lambda c: F.coalesce(least(hs, c), F.lit(PRIME).cast("long"))))


def band_keys(sig: Column, bands: int = BANDS, rows: int = HASHES // BANDS) -> Column:
    key = lambda s, b: F.md5(F.concat_ws(",", F.transform(F.slice(s, b * rows + 1, rows), lambda v: v.cast("string"))))
    return let(sig, lambda s: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: key(s, b)))


def agreement(a: Column, b: Column) -> Column:
    """How many values of two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def ids_hash(ids: Column) -> Column:
    """sha256 over 4-byte big-endian ids."""
    return F.sha2(F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 8, "0")), "")), 256)


def mask_hash(mask: Column) -> Column:
    """sha256 over one byte per flag."""
    return F.sha2(F.unhex(F.array_join(F.transform(mask, lambda i: F.lpad(F.hex(i), 2, "0")), "")), 256)


def unit_interval(text: Column) -> Column:
    """The hash of a text as a number of ten thousandths from 0 to 9999."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") * 10000 / F.lit(1 << 32)).cast("long")
