"""Redaction of personal data, and an independent scan for what may have been left.

`redacted` runs all ordered steps in one Arrow pass and returns struct<text, counts>; raw values never leave it. The
leak scan is native. Step order is semantic: the more specific identifier wins.
"""

from __future__ import annotations

import logging
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns, in the order in which they are applied.
PATTERNS = (
    ("EMAIL", r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"),
    ("URL", r"(?i)\b(?:https?://|www\.)[^\s<>\"']+|\b[a-z0-9][a-z0-9-]{1,62}\.(?:com|net|org|io|ly|co|me|gl|us|uk|in|tv|fm|info|biz)(?:/[^\s<>\"']*)?(?![\w@])"),
    ("URL_TAIL", r"\[URL\]\s?/[^\s]+"),
    ("ORDER_ID", r"(?i)\b(?:ORD(?:ER)?[-#]\s?\d{4,}|order\s*(?:#|no\.?|number|id)\s*[:#]?\s*[A-Z0-9-]*\d{4,}[A-Z0-9-]*)"),
    ("ACCOUNT_ID", r"(?i)\b(?:ACC(?:T|OUNT)?[-#]\s?\d{4,}|account\s*(?:#|no\.?|number|id)\s*(?:is\s*)?[:#]?\s*[A-Z0-9-]*\d{4,}[A-Z0-9-]*)"),
    ("CUSTOMER_ID", r"(?i)\b(?:CUST(?:OMER)?[-#]\s?\d{4,}|customer\s*(?:#|no\.?|number|id)\s*(?:is\s*)?[:#]?\s*[A-Z0-9-]*\d{4,}[A-Z0-9-]*)"),
    ("REFERENCE_ID", r"(?i)\b(?:case|ticket|reference|ref|confirmation|claim|incident|request|tracking|serial|licen[cs]e|registration|product)\s*(?:#|no\.?|number|id|code|key)?\s*(?:is\s*)?[:#]?\s*[A-Z0-9-]*\d{5,}[A-Z0-9-]*|(?<![\w&])#\s?\d{5,}\b"),
    ("CARD", r"(?<![\w-])(?:\d[ -]?){12,18}\d(?![\w-])"),
    ("PHONE", r"(?<![\w])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{2,5}(?:[\s.-]\d{2,8}){1,3}(?![\w])|(?<![\w])\+\d{7,14}(?![\w])"),
    ("BARE_PHONE", r"(?<![\w.,/=&?-])\+?\d{10,12}(?![\w.,/-])"),
    ("USER", r"(?<![\w@\[])@[A-Za-z0-9_]{1,30}"),
    ("USER", r"(?<=\])@[A-Za-z0-9_]{1,30}"),
)
# Cues before a person's name.
HONORIFIC = r"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof)\.?\s+([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)"
STRONG_CUE = r"(?i:\b(?:my name is|name's|signed|regards,?|sincerely,?)\s+)([A-Za-z][a-z]{1,20}(?:\s[A-Za-z][a-z]{1,20})?)"
WEAK_CUE = r"(?i:\b(?:this is|i am|i'm|im|call me)\s+)([A-Z][a-z]{1,20}(?:[-'][A-Z][a-z]+)?\s[A-Z][a-z]{1,20}(?:[-'][A-Z][a-z]+)?)\b"
KNOWN_CUE = r"(?i:\b(?:this is|i am|i'm|im|call me|it's|from)\s+)([A-Za-z][a-z]{1,20}(?:\s[A-Za-z][a-z]{1,20})?)\b"
# First names that a weak cue makes a person.
FIRST_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark steven paul andrew joshua kevin "
    "brian george edward mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa emma olivia sophia sofia "
    "isabella mia amelia liam noah oliver priya rahul amit anita arjun deepa vikram neha rohan aisha fatima omar ali hassan "
    "maria jose carlos juan luis ana chen wei li yuki hiroshi kim min ivan olga anna pierre marie hans lars sven chidi ngozi".split()
)
# Words after a cue that are no names.
NOT_NAMES = frozenset(
    "the a an not so very really just such terrible great awful amazing good bad best worst ridiculous unacceptable fine okay ok going "
    "done sure happy sad sorry tired bored my your our their it what why how still never always here there back home off on in "
    "out at and stuck gonna getting trying literally totally absolutely honestly seriously writing but from with again please is was i "
    "me you to for team all everyone support customer service app thanks thank".split()
)
# The scan's patterns; a run of digits also has to be no benign one.
LEAKS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
    "url": r"(?i)https?://|\bwww\.[a-z0-9]",
    "long_digit_run": r"\d(?:[ ()+.-]?\d){6,}",
    "prefixed_id": r"(?i)\b(?:ORD|ACC|CUST)-?\d{4,}",
    "handle": r"(?<![\w\[])@[A-Za-z0-9_]{2,}",
}
_DATES = tuple(re.compile(p) for p in (r"(?:19|20)\d{2}[-./]\d{1,2}[-./]\d{1,2}", r"\d{1,2}[-./]\d{1,2}[-./](?:19|20)?\d{2}"))
_COMPILED = tuple((kind, re.compile(p)) for kind, p in PATTERNS)
_DIGIT = re.compile(r"\d")
# What a text must hold for a pattern to match at all; looked for first, since most texts hold little of it.
_LINKED = re.compile(r"(?i)\.(?:com|net|org|io|ly|co|me|gl|us|uk|in|tv|fm|info|biz)")
_FOUR_DIGITS = re.compile(r"\d{4}")
_NEEDS = {
    "EMAIL": lambda s: "@" in s,
    "URL": lambda s: "://" in s or "." in s and (_LINKED.search(s) or "www." in s.casefold()),
    "URL_TAIL": lambda s: "[URL]" in s,
    "USER": lambda s: "@" in s,
}
_LONG_NUMBERS = ("ORDER_ID", "ACCOUNT_ID", "CUSTOMER_ID", "REFERENCE_ID")
_CUE_WORDS = {
    "honorific": ("Mr", "Ms", "Miss", "Mx", "Dr", "Prof"),
    "strong": ("my name is", "name's", "signed", "regards", "sincerely"),
    "weak": ("this is", "i am", "i'm", "im", "call me"),
    "known": ("this is", "i am", "i'm", "im", "call me", "it's", "from"),
}
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType()))])


def _accepts(kind: str, found: str) -> bool:
    """The checks beyond the pattern."""
    n = sum(ch.isdigit() for ch in found)
    if kind == "CARD":
        return 13 <= n <= 19
    if kind == "PHONE":
        return 7 <= n <= 15 and not any(d.fullmatch(found.strip()) for d in _DATES)
    if kind == "BARE_PHONE":
        return len(set(found.lstrip("+"))) > 2
    return True


def _leading_name(words: list[str]) -> str:
    """The name at the start of one or two words: the second belongs to it unless it is a common word."""
    return " ".join(words[: 2 if len(words) == 2 and words[1].lower() not in NOT_NAMES else 1])


def _person(cue: str, words: list[str]) -> str | None:
    """The part of a cue's words that is a name, or None."""
    if cue == "strong":
        return None if words[0].lower() in NOT_NAMES else _leading_name(words)
    if cue == "known":
        return _leading_name(words) if words[0].lower() in FIRST_NAMES else None
    return None if cue == "weak" and any(w.lower() in NOT_NAMES for w in words) else ""


_CUES = tuple((cue, re.compile(p)) for cue, p in (("honorific", HONORIFIC), ("strong", STRONG_CUE), ("weak", WEAK_CUE), ("known", KNOWN_CUE)))


def _pass(s: str, count) -> str:
    """One run of all steps over a text; count is told the kind of each value that goes."""
    digits = _DIGIT.search(s)  # looked for once: steps bring no digits and join none
    four = digits and _FOUR_DIGITS.search(s)
    for kind, pattern in _COMPILED:
        if not (_NEEDS[kind](s) if kind in _NEEDS else four if kind in _LONG_NUMBERS else digits):
            continue
        shown = {"BARE_PHONE": "PHONE", "URL_TAIL": "URL"}.get(kind, kind)

        def put(m: re.Match, kind=kind, shown=shown) -> str:
            if not _accepts(kind, m.group()):
                return m.group()
            if kind != "URL_TAIL":
                count(shown)
            return f"[{shown}]"

        s = pattern.sub(put, s)
    folded = s.casefold().replace("\u0131", "i")  # as patterns without case see it
    for cue, pattern in _CUES:
        if not any(w in (s if cue == "honorific" else folded) for w in _CUE_WORDS[cue]):
            continue

        def hide(m: re.Match, cue=cue) -> str:
            name = _person(cue, m.group(1).split())
            if name is None:
                return m.group()
            count("PERSON")
            at = m.start(1) - m.start()  # the cue may hold the name's letters too
            return f"{m.group()[:at]}[PERSON]{m.group(1)[len(name or m.group(1)) :]}{m.group()[m.end(1) - m.start() :]}"

        s = pattern.sub(hide, s)
    return s


def redact_text(text: str | None, ner=None) -> tuple[str, dict[str, int]]:
    """A text without personal data, and how many of each kind went. `ner` may name spans (start, end, score).

    The steps run until they change nothing, for a value that went can leave another one beside it open to a step that had passed. They come
    to an end: what goes always holds a character outside all placeholders, and nothing is added outside them.
    """
    counts: dict[str, int] = {}
    s, before = text or "", None

    def count(kind: str) -> None:
        counts[kind] = counts.get(kind, 0) + 1

    while s != before:
        s, before = _pass(s, count), s
    if ner is not None:
        for start, end, score in sorted(ner(s), reverse=True):
            if score >= 0.90 and not s[start:end].startswith("["):
                count("PERSON")
                s = f"{s[:start]}[PERSON]{s[end:]}"
    return s, counts


@F.pandas_udf(RESULT)
def redacted(texts: pd.Series) -> pd.DataFrame:
    """struct<text, counts>; a null text gives an empty one without counts."""
    found = [redact_text(t) for t in texts]
    return pd.DataFrame({"text": [t for t, _ in found], "counts": [c for _, c in found]})


@F.pandas_udf(T.StringType())
def safe_text(texts: pd.Series) -> pd.Series:
    """Redaction again, at the edge; it changes nothing in redacted text."""
    return texts.map(lambda t: None if t is None else redact_text(t)[0])


def benign_digits(run: Column) -> Column:
    """Runs that are no identifier: one repeated digit, round numbers, dates, and version numbers."""
    digits = F.regexp_replace(run, r"\D", "")
    parts = F.split(run, r"\.")
    version = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^\d+$")) & F.exists(parts, lambda p: p.rlike(r"^0*(?:[1-9]\d{3,}|[3-9]\d\d|2[6-9]\d|25[6-9])$"))
    return (
        digits.rlike(r"^(\d)\1*$")
        | digits.rlike(r"^[1-9]\d{0,2}0{4,}$")
        | run.rlike(r"^(19|20)\d{2}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$")
        | digits.rlike(r"^(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(19|20)\d{2}$")
        | version
    )


def leak_hits(c: Column) -> Column:
    """Names of the patterns that a text matches, in the order of LEAKS."""
    text = F.coalesce(c, F.lit(""))
    found = []
    for name, pattern in LEAKS.items():
        if name == "long_digit_run":
            hit = F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda run: ~benign_digits(run))
        else:
            hit = text.rlike("(?U)" + pattern if name == "handle" else pattern)
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def leak_tally(df: DataFrame, text: str) -> DataFrame:
    """(pattern, n): texts that each pattern hits."""
    return df.select(F.explode(leak_hits(F.col(text))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def counts_by_type(df: DataFrame, counts: str = "counts") -> DataFrame:
    return df.select(F.explode(counts).alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n"))


class RedactingFilter(logging.Filter):
    """Redacts every record before it is emitted."""

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = redact_text(record.getMessage())[0], ()
        return True
