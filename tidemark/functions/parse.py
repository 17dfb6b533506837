"""Parsing of loosely typed fields: dates, ratings, labels, ids, hash-based splits."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import squeezed

# Date patterns after ISO, day before month, each with the strict shape it needs.
DATE_FORMATS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d/M/yyyy H:m", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"),
    ("M/d/yyyy H:m", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"),
)
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?([+-]\d{2}(:?\d{2})?|Z)?)?$"
BASIC = r"^(\d{4})(\d{2})(\d{2})$"
# Spellings of the three labels.
LABELS = {"neg": "negative", "neu": "neutral", "pos": "positive", "0": "negative", "1": "negative", "2": "neutral", "3": "neutral", "4": "positive", "5": "positive"}
SENTIMENTS = ("negative", "neutral", "positive")
SAFE_ID = r"^[A-Za-z0-9_-]{1,40}$"


def _iso(v: Column) -> Column:
    """ISO date and time to a naive UTC timestamp; null if it isn't one."""
    full = F.regexp_replace(F.regexp_replace(v, ",", "."), "[ ]", "T")
    full = F.regexp_replace(full, r"(T\d{2})(?=$|[+-]|Z)", "$1:00")
    full = F.regexp_replace(full, r"([+-]\d{2})(\d{2})$", "$1:$2")
    full = F.when(full.rlike(r"T.*[+-]\d{2}$"), F.concat(full, F.lit(":00"))).otherwise(full)
    zoned = F.when(full.rlike(r"T.*([+-]\d{2}:\d{2}|Z)$"), F.try_to_timestamp(full).cast("timestamp_ntz"))
    naive = F.when(~full.rlike(r"T.*([+-]\d{2}:\d{2}|Z)$"), full.try_cast("timestamp_ntz"))
    return F.when(v.rlike(ISO), F.coalesce(zoned, naive))


def any_date(c: Column) -> Column:
    """A timestamp_ntz from ISO or one of the formats; the session's zone must be UTC."""
    v = squeezed(F.coalesce(c, F.lit("")))
    found = [_iso(v), F.when(v.rlike(BASIC), F.regexp_replace(v, BASIC, "$1-$2-$3").try_cast("timestamp_ntz"))]
    for pattern, shape in DATE_FORMATS:
        found.append(F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(pattern)).cast("timestamp_ntz")))
    return F.coalesce(*found)


def tweet_date(c: Column) -> Column:
    """'Mon Apr 06 22:19:45 PDT 2009', the zone left out; null if it has other than six tokens."""
    t = F.split(squeezed(c), " ")
    joined = F.array_join(F.array(*[F.element_at(t, k) for k in (2, 3, 4, 6)]), " ")
    return F.when(F.size(t) == 6, F.try_to_timestamp(joined, F.lit("MMM d HH:mm:ss yyyy")).cast("timestamp_ntz"))


def rating(c: Column) -> Column:
    """A whole number from text, half to even; null if it is none or not finite."""
    x = squeezed(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < 2e9), F.rint(x)).try_cast("int")


def label(c: Column) -> Column:
    """One of the three labels, or null."""
    v = F.lower(squeezed(c))
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    named = F.coalesce(F.try_element_at(known, v), v)
    return F.when(named.isin(*SENTIMENTS), named)


def stars(c: Column) -> Column:
    return F.when(c <= 2, "negative").when(c == 3, "neutral").when(c >= 4, "positive")


def pseudonym(user: Column) -> Column:
    return F.concat(F.lit("user_"), F.substring(F.sha2(user, 256), 1, 10))


def hex_mod(digest: Column, n: int) -> Column:
    """A hexadecimal number modulo n, digit by digit."""
    return F.aggregate(F.split(digest, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(F.pmod(a * 16 + F.conv(ch, 16, 10).cast("int"), F.lit(n))))


def split_by_sha(text: Column) -> Column:
    """train, val or test in 80:10:10 by SHA-256 of the trimmed lower-case text."""
    v = hex_mod(F.sha2(F.lower(squeezed_ends(text)), 256), 100)
    return F.when(v < 80, "train").when(v < 90, "val").otherwise("test")


def squeezed_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_by_blake(seed: int = 42):
    """train, val or test in 80:10:10 by BLAKE2b of 'seed:key'; no built-in hashes so."""

    @F.pandas_udf("string")
    def assign(keys: pd.Series) -> pd.Series:
        def one(key):
            v = int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode("utf-8", "replace"), digest_size=8).digest(), "big") % 1000
            return "train" if v < 800 else "val" if v < 900 else "test"

        return keys.map(lambda k: None if k is None else one(k))

    return assign


def hashed_date(c: Column, start: str = "2024-01-01") -> Column:
    """A reproducible timestamp within 360 days of `start`, from a text's hash."""
    v = F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval((v % 360).cast("int"), F.lit(0), F.lit(0), (v % 86400).cast("double"))


def safe_filename(c: Column) -> Column:
    """A name with safe characters only, at most 80, that ends in .csv."""
    cut = F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), 1, 80)
    return F.when(F.lower(cut).endswith(".csv"), cut).otherwise(F.concat(cut, F.lit(".csv")))
