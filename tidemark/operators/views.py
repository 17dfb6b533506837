"""The read queries: each takes tables and parameters and returns a DataFrame in the order of the page it serves."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pii
from tidemark.operators.radar import STATUSES, status_rank

# Limits of the inputs.
THEME_ID, REVIEW_ID = re.compile(r"theme_\d{3,}|[a-z_]+"), re.compile(r"[A-Za-z0-9_-]{1,40}")
MOST_CHARS, MOST_ROWS, MOST_OFFSET = 60, 200, 1_000_000
SORT_KEYS = ("size", "negative_pct", "priority", "growth_pct", "name")
PUBLIC = ("review_id", "created_at", "rating", "platform", "app_version", "text", "sentiment", "confidence", "theme_id", "theme_assignment", "pii_redaction_count", "source")
TABS = {"Actionable": ("NEW", "EMERGING", "DECLINING"), "Emerging": ("NEW", "EMERGING"), "All": STATUSES}


def _checked(value: str | None, shape: re.Pattern) -> str | None:
    if value is not None and not shape.fullmatch(value):
        raise ValueError(f"not allowed: {value!r}")
    return value


def public(reviews: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """The public fields, text redacted once more, with the theme's name."""
    out = reviews.withColumn("text", pii.safe_text("text_redacted")) if "text_redacted" in reviews.columns else reviews
    have = [c for c in PUBLIC if c in out.columns]
    if themes is None:
        return out.select(*have)
    return out.join(themes.select("theme_id", F.col("name").alias("theme_name")), "theme_id", "left").select(*have, "theme_name")


def matching(reviews: DataFrame, theme_id: str | None = None, sentiment: str | None = None, q: str | None = None, text: str = "text_redacted") -> DataFrame:
    """Filters of the review page; q is a literal substring, A-Z without case."""
    if q is not None and len(q) > MOST_CHARS:
        raise ValueError("q is too long")
    if _checked(theme_id, THEME_ID):
        reviews = reviews.where(F.col("theme_id") == theme_id)
    if sentiment:
        reviews = reviews.where(F.col("sentiment") == sentiment)
    if q:
        fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        reviews = reviews.where(F.contains(fold(F.col(text)), fold(F.lit(q))))
    return reviews


def page(reviews: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """Newest first, undated last, by id within a time; a window of the order."""
    if not (1 <= limit <= MOST_ROWS and 0 <= offset <= MOST_OFFSET):
        raise ValueError("limit or offset out of range")
    return reviews.orderBy(F.col("created_at").desc_nulls_last(), "review_id").offset(offset).limit(limit)


def page_label(total: int, limit: int = 25, offset: int = 0) -> str:
    """Which rows a page shows: a-b of n."""
    return f"{min(offset + 1, total)}-{min(offset + limit, total)} of {total}"


def total(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count("*").alias("n"))


def themes_listed(themes: DataFrame, complaints_only: bool = False, sort: str = "size", q: str | None = None) -> DataFrame:
    if sort not in SORT_KEYS:
        raise ValueError(f"unknown sort {sort}")
    if complaints_only:
        themes = themes.where("is_complaint")
    if q:
        low = q.lower()
        themes = themes.where(F.contains(F.lower("name"), F.lit(low)) | F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.contains(k, F.lit(low))))
    key = F.col(sort)
    return themes.orderBy(key.asc_nulls_last() if sort == "name" else key.desc_nulls_last(), "theme_id")


def theme_detail(themes: DataFrame, issues: DataFrame, theme_id: str) -> DataFrame:
    return themes.where(F.col("theme_id") == _checked(theme_id, THEME_ID)).join(issues.drop("name"), "theme_id", "left")


def theme_reviews(themes: DataFrame, reviews: DataFrame, theme_id: str) -> DataFrame:
    """A theme's representatives in their order."""
    ids = themes.where(F.col("theme_id") == _checked(theme_id, THEME_ID)).select(F.posexplode("representative_ids").alias("rank", "review_id"))
    return reviews.join(ids, "review_id").orderBy("rank")


def segments(reviews: DataFrame, theme_id: str) -> DataFrame:
    """(segment, value, n) of a theme, in one pass."""
    own = reviews.where(F.col("theme_id") == _checked(theme_id, THEME_ID))
    pairs = F.array(*[F.struct(F.lit(s).alias("segment"), F.col(s).alias("value")) for s in ("app_version", "platform")])
    return own.select(F.inline(pairs)).where("value is not null").groupBy("segment", "value").agg(F.count("*").alias("n"))


def issues_listed(issues: DataFrame, statuses: str | None = None) -> DataFrame:
    if statuses:
        if not re.fullmatch(r"[A-Z_,]{1,120}", statuses):
            raise ValueError("bad status list")
        issues = issues.where(F.col("status").isin(*statuses.split(",")))
    return issues.orderBy(status_rank(F.col("status")), F.desc("priority"), "theme_id")


def tab(issues: DataFrame, name: str) -> DataFrame:
    return issues_listed(issues.where(F.col("status").isin(*TABS[name])))


def evidence_of(evidence: DataFrame, reviews: DataFrame, theme_id: str) -> DataFrame:
    """Evidence with its reviews, representatives first."""
    own = evidence.where(F.col("theme_id") == _checked(theme_id, THEME_ID)).withColumnRenamed("theme_id", "issue_id")
    return reviews.join(own, "review_id").orderBy(F.desc("kind"), "rank")


def review_detail(reviews: DataFrame, evidence: DataFrame, review_id: str) -> DataFrame:
    own = reviews.where(F.col("review_id") == _checked(review_id, REVIEW_ID))
    used = evidence.where(F.col("review_id") == review_id).groupBy("review_id").agg(F.sort_array(F.collect_list(F.struct("theme_id", "kind", "rank"))).alias("used_as_evidence"))
    return own.join(used, "review_id", "left")


def top_complaints(rolled: DataFrame, k: int = 8) -> DataFrame:
    return rolled.where("is_complaint").orderBy(F.desc("negative_count"), "theme_id").limit(k)


def pii_types(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("n"), "type")


def in_window(weekly: DataFrame) -> DataFrame:
    """(theme_id, bucket, n, in_window): the last two buckets are the current window."""
    out = weekly.select("theme_id", F.posexplode("weekly_counts").alias("bucket", "n"), F.size("weekly_counts").alias("k"))
    return out.select("theme_id", "bucket", "n", (F.col("bucket") >= F.col("k") - 2).alias("in_window"))
