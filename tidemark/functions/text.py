"""Text repair, tidying, validation, tokens and variants, as column expressions where Spark has them."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import mojibake

# Redaction placeholders.
PLACEHOLDERS = ("EMAIL", "URL", "CARD", "ORDER_ID", "ACCOUNT_ID", "CUSTOMER_ID", "REFERENCE_ID", "PHONE", "USER", "PERSON")
PLACEHOLDER = r"\[(?:" + "|".join(PLACEHOLDERS) + r")\]"
# Control characters that become spaces; white space as the host language sees it.
CONTROL = r"[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f\u200b\ufeff]"
SPACE = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CONTROL, _SAME, _MIXED = re.compile(CONTROL), re.compile(r"([!?.])\1{3,}"), re.compile(r"([!?]{3})[!?]+")
# The characters of SPACE.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Generic review words that say nothing about a topic.
DOMAIN_STOPWORDS = (
    "app apps please fix asap really just honestly seriously ugh wow hmm okay ok fyi note thanks thank love hate star stars "
    "update updated terrible experience disappointed happy frustrating annoying uninstalling resolved otherwise fine hope improves "
    "keep good great work lol im don didn doesn ve ll got get like use using used time day today now new worst ever"
).split()


@F.pandas_udf(T.StringType())
def unescaped_nfc(s: pd.Series) -> pd.Series:
    """Mojibake repair, HTML entities, NFC: no built-in does these."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", html.unescape(mojibake.repaired(x))))


@F.pandas_udf(T.StringType())
def only_unescaped_nfc(s: pd.Series) -> pd.Series:
    """HTML entities and NFC, without mojibake repair."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", html.unescape(x)))


@F.pandas_udf(T.StringType())
def _html_unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def html_unescaped(c: Column | str) -> Column:
    """Without HTML entities. Only texts with an ampersand go to Python; no other has any."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_html_unescaped(F.when(F.contains(c, F.lit("&")), c)), c)


@F.pandas_udf(T.StringType())
def demojibaked(s: pd.Series) -> pd.Series:
    """Mojibake repair alone."""
    return s.map(lambda x: None if x is None else mojibake.repaired(x))


@F.pandas_udf(T.BooleanType())
def is_mojibake(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x is not None and mojibake.repaired(x) != x)


def repaired(c: Column) -> Column:
    return F.regexp_replace(unescaped_nfc(c), CONTROL, " ")


def unrepaired(c: Column) -> Column:
    """As repaired, but mojibake stays."""
    return F.regexp_replace(only_unescaped_nfc(c), CONTROL, " ")


def unrepaired_text(s: str) -> str:
    """What unrepaired gives, for code that has the text in Python; repaired gives the same of text without mojibake."""
    return _CONTROL.sub(" ", unicodedata.normalize("NFC", html.unescape(s)))


def squeezed_text(s: str) -> str:
    """What squeezed gives: split() knows the same white space."""
    return " ".join(s.split())


def tidied_text(s: str) -> str:
    """What tidied gives."""
    if "...." in s or "!!!!" in s or "????" in s:
        s = _SAME.sub(r"\1\1\1", s)
    if "!" in s or "?" in s:
        s = _MIXED.sub(r"\1", s)
    return squeezed_text(s)


def squeezed(c: Column) -> Column:
    """White space of any length to one space, trimmed."""
    return F.btrim(F.regexp_replace(c, SPACE + "+", " "))


def tidied(c: Column) -> Column:
    """Runs of four or more of one of !?. become three, mixed runs of ! and ? are cut to three, white space is squeezed."""
    s = F.regexp_replace(c, r"([!?.])\1{3,}", "$1$1$1")
    s = F.regexp_replace(s, r"([!?]{3})[!?]+", "$1")
    return squeezed(s)


def model_input(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("[USER]"), F.lit("@user")), F.lit("[URL]"), F.lit("http"))


def reject_reason(raw: Column, cleaned: Column) -> Column:
    """Why a text is rejected; null: it is kept."""
    return (
        F.when(raw.isNull(), "null_text")
        .when(F.btrim(raw, F.lit(SPACES)) == "", "empty_text")
        .when(cleaned.isNull() | ~cleaned.rlike(r"(?U)\w"), "no_content_after_cleaning")
    )


def stripped(c: Column) -> Column:
    """Without placeholders; the text itself if nothing else is left."""
    s = squeezed(F.regexp_replace(c, PLACEHOLDER, " "))
    return F.when(s == "", c).otherwise(s)


def stop_words(language: str = "english") -> list[str]:
    """Spark's own list for the language and the domain's words."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords(language)} | set(DOMAIN_STOPWORDS))


def tokens(c: Column, stop: list[str]) -> Column:
    """Lower-case runs of two or more letters, less the stop words, in order."""
    found = F.split(F.lower(F.regexp_replace(c, PLACEHOLDER, " ")), "[^a-z]+")  # half the time of matching the words
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*stop) if stop else F.length(w) > 1)  # a set, not a list to go through


def stem(w: Column) -> Column:
    """Drops the first of ing, ed, es, s that fits when more than three letters stay."""
    out = w
    for suffix in ("s", "es", "ed", "ing"):  # the last one tested wins, so it is tried first
        n = len(suffix)
        out = F.when(w.endswith(suffix) & (F.length(w) > n + 3), F.substring(w, F.lit(1), F.length(w) - n)).otherwise(out)
    return out


def title(c: Column) -> Column:
    return F.initcap(c)


def masked(c: Column, n: int = 220) -> Column:
    return F.substring(F.regexp_replace(c, r"\d", "#"), 1, n)


def group_key(c: Column) -> Column:
    """Key under which texts count as the same for splitting: unescaped, lower, mentions and links unified."""
    s = F.lower(html_unescaped(c))
    s = F.regexp_replace(s, r"(?U)@\w+", "@user")
    s = F.regexp_replace(s, r"(?U)(https?://\S+|www\.\S+)", "http")
    return squeezed(s)


# Negation tokens.
NEGATION = (
    r"(?iU)\b(?:not|no|never|none|nobody|nothing|neither|nor|cannot|without|n't|\w+n't|dont|cant|wont|didnt|isnt|doesnt|"
    r"wasnt|werent|havent|hasnt|hadnt|shouldnt|wouldnt|couldnt|aint|arent)\b"
)


def negations(c: Column) -> Column:
    return F.regexp_count(html_unescaped(c), F.lit(NEGATION))


def like_pattern(q: str) -> str:
    """User text as a literal inside a LIKE pattern."""
    return "".join("\\" + ch if ch in "%_\\" else ch for ch in q)
