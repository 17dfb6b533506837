"""Complaint radar: which complaint themes grow between two anchored windows, with every number behind the verdict.

Windows end at the batch's last timestamp (or a given one), are left-open and right-closed, and all
counts of a theme come from one aggregation over the reviews. Every theme of the spine is reported, also without reviews.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clipped, ratio, rounded
from tidemark.shared import Stored

# Statuses in report order.
STATUSES = ("NEW", "EMERGING", "STABLE", "DECLINING", "INSUFFICIENT_EVIDENCE", "NOT_A_COMPLAINT", "NO_DATA")
SEGMENTS = ("app_version", "platform")


@dataclass(frozen=True)
class Params:
    # Thresholds of the decision table.
    window_days: int = 14
    min_current_mentions: int = 30
    min_evidence_reviews: int = 3
    min_growth_pct: float = 50.0
    min_negative_ratio: float = 0.50
    decline_pct: float = 25.0
    soft_decline_pct: float = 15.0
    max_growth_bonus: float = 3.0
    n_evidence: int = 5
    trend_bucket_days: int = 7
    min_segment_support: int = 20
    min_segment_lift: float = 1.3
    mentions_floor: int = 8
    mentions_ceiling: int = 30
    full_batch: int = 5000
    small_batch: int = 200


def mention_gate(n: Column, p: Params = Params()) -> Column:
    """The least number of mentions: 1.5 % of the batch within the floor and the ceiling."""
    top = min(p.min_current_mentions, p.mentions_ceiling)
    scaled = F.rint(n * F.lit(0.015)).cast("int")
    return F.when(n <= 0, p.mentions_floor).when(n >= p.full_batch, top).otherwise(clipped(scaled, p.mentions_floor, top))


def evidence_gate(n: Column, p: Params = Params()) -> Column:
    return F.when(n < p.small_batch, 2).otherwise(p.min_evidence_reviews)


def growth(current: Column, previous: Column) -> Column:
    """Percent change, two decimals; null without a base; negative counts raise."""
    safe = F.when((current < 0) | (previous < 0), F.raise_error(F.lit("counts must be non-negative")).cast("double"))
    return safe.when(previous > 0, rounded((current - previous) / previous * 100.0, 2))


def growth_factor(g: Column, previous: Column, current: Column, cap: float) -> Column:
    grown = 1.0 + clipped(F.coalesce(g, F.lit(0.0)) / 100.0, 0.0, cap)
    return F.when((previous == 0) & (current > 0), 1.0 + cap).otherwise(grown)


def growth_label(g: Column, previous: Column, current: Column) -> Column:
    whole = F.rint(g)
    number = F.format_string("%.0f%%", F.when((whole == 0) & (g < 0), F.lit(-0.0)).otherwise(whole))
    return F.when((previous == 0) & (current > 0), "NEW").when(g.isNull(), "n/a").otherwise(F.concat(F.when(g > 0, "+").otherwise(""), number))


def anchors(reviews: DataFrame, p: Params = Params(), as_of: datetime | None = None) -> DataFrame:
    """One row: the windows' borders, counts of the batch, and the gates that follow from them."""
    ts = F.col("created_at")
    end = F.lit(as_of).cast("timestamp_ntz") if as_of else F.max(ts)
    day = F.expr(f"INTERVAL {p.window_days} DAYS")
    one = reviews.agg(end.alias("window_end"), F.min(ts).alias("first_ts"), F.count(ts).alias("dated"), (F.count("*") - F.count(ts)).alias("malformed"))
    span = F.expr("timestampdiff(MICROSECOND, first_ts, window_end)") / F.lit(p.trend_bucket_days * 86_400_000_000.0)
    one = one.withColumns({"current_start": F.col("window_end") - day, "n_buckets": F.greatest(F.lit(1), F.ceil(span)).cast("int")})
    one = one.withColumn("previous_start", F.col("current_start") - day)
    return one.withColumns({"has_previous": F.col("first_ts") <= F.col("current_start"), "min_mentions": mention_gate(F.col("dated"), p), "min_evidence": evidence_gate(F.col("dated"), p)})


def bucket(ts: Column, end: Column, n: Column, days: int) -> Column:
    """0-based number of the tumbling bucket that ends the series at `end`; null outside; the series' start is outside."""
    back = F.timestamp_diff("MICROSECOND", ts, end)
    width = days * 86_400_000_000
    offset = n.cast("long") * width - back
    return F.when((offset > 0) & (back >= 0), F.least(n - 1, F.floor(offset / F.lit(width)).cast("int")))


def placed(reviews: DataFrame, p: Params = Params(), as_of: datetime | None = None, one: DataFrame | None = None) -> DataFrame:
    """Dated reviews with the borders (`one`: the row of anchors, if it is known), their bucket, and in_current / in_previous."""
    rows = reviews.where(F.col("created_at").isNotNull()).crossJoin(F.broadcast(anchors(reviews, p, as_of) if one is None else one))  # one row
    ts = F.col("created_at")
    return rows.withColumns(
        {
            "bucket": bucket(ts, F.col("window_end"), F.col("n_buckets"), p.trend_bucket_days),
            "in_current": (ts > F.col("current_start")) & (ts <= F.col("window_end")),
            "in_previous": (ts > F.col("previous_start")) & (ts <= F.col("current_start")),
        }
    )


def weekly_counts(rows: DataFrame) -> DataFrame:
    """(theme_id, weekly_counts): one count for each bucket of the batch, zeros included."""
    counted = rows.where("bucket is not null and theme_id is not null").groupBy("theme_id", "bucket").agg(F.count("*").alias("n"), F.first("n_buckets").alias("n_buckets"))
    grouped = counted.groupBy("theme_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("by"), F.first("n_buckets").alias("n_buckets"))
    filled = F.transform(F.sequence(F.lit(0), F.col("n_buckets") - 1), lambda i: F.coalesce(F.element_at("by", i), F.lit(0).cast("long")))
    return grouped.select("theme_id", filled.alias("weekly_counts"))


def relative_slope(counts: Column) -> Column:
    """Least-squares slope over the mean of a series."""
    n = F.size(counts).cast("double")
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    moment = F.aggregate(F.transform(counts, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    slope = (moment - total * (n - 1) / 2.0) / (n * (n * n - 1) / 12.0)
    return slope / (total / n)


def trend(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    enough = (F.size(counts) >= 3) & (total > 0)
    slope = F.when(enough, relative_slope(counts))
    return F.when(~enough, "insufficient_periods").when(slope > 0.05, "rising").when(slope < -0.05, "falling").otherwise("stable")


def acceleration(counts: Column) -> Column:
    """Growth of the last bucket less growth of the one before, in percentage points; null without two bases."""
    at = lambda k: F.try_element_at(counts, F.lit(k)).cast("double")
    a, b, c = at(-3), at(-2), at(-1)
    return F.when((F.size(counts) >= 3) & (a != 0) & (b != 0), rounded(((c - b) / b - (b - a) / a) * 100.0, 2))


def theme_counts(rows: DataFrame, themes: DataFrame) -> DataFrame:
    """Window counts of every theme of the spine, in one aggregation."""
    cur, prev, neg = F.col("in_current"), F.col("in_previous"), F.col("sentiment") == "negative"
    counted = rows.where("theme_id is not null").groupBy("theme_id").agg(
        F.count_if(cur).alias("current"), F.count_if(prev).alias("previous"), F.count_if(cur & neg).alias("negative_current"), F.count_if(neg).alias("negative_all"), F.count("*").alias("total")
    )
    out = themes.select("theme_id", "name").join(counted, "theme_id", "left")
    return out.fillna(0, ["current", "previous", "negative_current", "negative_all", "total"])


def status(p: Params = Params()) -> Column:
    """The decision table, first match wins; expects the columns of `decided`."""
    c, pv, g = F.col("current"), F.col("previous"), F.col("growth_pct")
    share = F.when(c > 0, F.col("ratio_current")).otherwise(F.col("ratio_all"))
    soft = (g <= -p.soft_decline_pct) & (F.col("trend") == "falling") & (pv >= F.col("min_mentions"))
    return (
        F.when((c == 0) & (pv == 0), "NO_DATA")
        .when(share < p.min_negative_ratio, "NOT_A_COMPLAINT")
        .when((c < F.col("min_mentions")) | (F.col("negative_current") < F.col("min_evidence")), "INSUFFICIENT_EVIDENCE")
        .when(~F.col("has_previous"), "INSUFFICIENT_EVIDENCE")
        .when(pv == 0, "NEW")
        .when(g >= p.min_growth_pct, "EMERGING")
        .when(g <= -p.decline_pct, "DECLINING")
        .when(soft, "DECLINING")
        .otherwise("STABLE")
    )


def evidence(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """(theme_id, review_id, rank): the current window's negatives, most similar first."""
    order = Window.partitionBy("theme_id").orderBy(F.coalesce("similarity", F.lit(0.0)).desc(), F.coalesce("confidence", F.lit(0.0)).desc(), "review_id")
    found = rows.where("in_current and sentiment = 'negative' and theme_id is not null").withColumn("rank", F.row_number().over(order) - 1)
    return found.where(F.col("rank") < p.n_evidence).select("theme_id", "review_id", "rank")


def segment_lift(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """Segments that stand out in a theme's current window: at most three a theme, by lift."""
    current = rows.where("in_current")
    pairs = F.array(*[F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("value")) for s in SEGMENTS])
    long = current.select("theme_id", F.inline(pairs)).where("value is not null and value != ''")
    counts = long.groupBy("segment", "value", "theme_id").agg(F.count("*").alias("support"))
    by_value = counts.groupBy("segment", "value").agg(F.sum("support").alias("value_n"))
    overall = by_value.withColumn("overall_share", F.col("value_n") / F.sum("value_n").over(Window.partitionBy("segment")))
    own = counts.where("theme_id is not null").withColumn("theme_share", F.col("support") / F.sum("support").over(Window.partitionBy("theme_id", "segment")))
    lifted = own.join(overall, ["segment", "value"]).withColumn("lift", F.col("theme_share") / F.col("overall_share"))
    kept = lifted.where((F.col("support") >= p.min_segment_support) & (F.col("lift") >= p.min_segment_lift))
    kept = kept.withColumns({"shown_lift": rounded(F.col("lift"), 2)})
    order = Window.partitionBy("theme_id").orderBy(F.desc("shown_lift"), "segment", "value")
    kept = kept.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    return kept.select("theme_id", "segment", "value", rounded(F.col("theme_share"), 4).alias("theme_share"), rounded(F.col("overall_share"), 4).alias("overall_share"), F.col("shown_lift").alias("lift"), "support", "rank", F.col("theme_share").alias("_share"), F.col("overall_share").alias("_overall"), F.col("lift").alias("_lift"))


def association_text(name: Column) -> Column:
    """What stands out, in words (fixed wording)."""
    pct = lambda c: F.rint(c * 100).cast("long").cast("string")
    return F.concat(
        pct(F.col("_share")), F.lit("% of current-window "), name, F.lit(" mentions are "), F.col("segment"), F.lit("="), F.col("value"), F.lit(", vs "),
        pct(F.col("_overall")), F.lit("% of all current-window reviews (lift "), F.format_string("%.2f", rounded(F.col("_lift"), 2)), F.lit("). This is an association, not evidence of cause."),
    )


def decided(reviews: DataFrame, themes: DataFrame, p: Params = Params(), as_of: datetime | None = None) -> DataFrame:
    """A row for each theme: counts, growth, trend, status and priority. No rows without a dated review."""
    return judged(*located(reviews, p, as_of), themes, p)


NEEDED = ("theme_id", "review_id", "sentiment", "similarity", "confidence", *SEGMENTS, "bucket", "n_buckets", "in_current", "in_previous")


def located(reviews: DataFrame, p: Params = Params(), as_of: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed reviews with the columns that the radar needs, the row of anchors), both stored, for several passes read them."""
    one = Stored(anchors(reviews, p, as_of)).read()
    rows = placed(reviews, p, as_of, one)
    return Stored(rows.select(*[c for c in NEEDED if c in rows.columns])).read(), one


def judged(rows: DataFrame, one: DataFrame, themes: DataFrame, p: Params = Params()) -> DataFrame:
    """decided() for located reviews and anchors."""
    one = one.where("dated > 0")
    out = theme_counts(rows, themes).join(F.broadcast(weekly_counts(rows)), "theme_id", "left").crossJoin(F.broadcast(one))  # one row
    zeros = F.transform(F.sequence(F.lit(1), F.col("n_buckets")), lambda _: F.lit(0).cast("long"))
    out = out.withColumns(
        {
            "weekly_counts": F.coalesce("weekly_counts", zeros),
            "ratio_current": ratio(F.col("negative_current"), F.col("current")),
            "ratio_all": ratio(F.col("negative_all"), F.col("total")),
            "growth_pct": growth(F.col("current"), F.col("previous")),
        }
    )
    out = out.withColumns({"trend": trend(F.col("weekly_counts")), "acceleration_pp": acceleration(F.col("weekly_counts")), "factor": growth_factor(F.col("growth_pct"), F.col("previous"), F.col("current"), p.max_growth_bonus)})
    return out.withColumns(
        {
            "status": status(p),
            "priority": rounded(F.col("negative_current") * F.col("factor"), 2),
            "growth_label": growth_label(F.col("growth_pct"), F.col("previous"), F.col("current")),
            "negative_ratio": rounded(F.col("ratio_current"), 4),
            "negative_ratio_all": rounded(F.col("ratio_all"), 4),
        }
    )


def number_text(c: Column) -> Column:
    """A double as the host language prints it: 12.5, 100.0."""
    return F.regexp_replace(F.format_string("%s", c.cast("string")), r"^(-?\d+)$", "$1.0")


def reason(p: Params = Params()) -> Column:
    """Why the status holds, in words (fixed wording)."""
    g, c = number_text(F.col("growth_pct")), F.col("current").cast("string")
    pct = lambda x: number_text(rounded(x * 100, 1))
    share = F.when(F.col("current") > 0, F.col("ratio_current")).otherwise(F.col("ratio_all"))
    gate = F.col("min_mentions").cast("string")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    insufficient = (
        F.when(F.col("current") < F.col("min_mentions"), say("current mentions ", c, " < ", gate))
        .when(F.col("negative_current") < F.col("min_evidence"), say("negative evidence reviews ", F.col("negative_current").cast("string"), " < ", F.col("min_evidence").cast("string")))
        .otherwise("batch does not cover a full previous window")
    )
    s = F.col("status")
    return (
        F.when(s == "NOT_A_COMPLAINT", say("negative ratio ", pct(share), f"% < {p.min_negative_ratio * 100:.0f}%"))
        .when(s == "INSUFFICIENT_EVIDENCE", insufficient)
        .when(s == "NEW", say("0 mentions in previous window, ", c, " in current window (>= ", gate, ")"))
        .when(s == "EMERGING", say("growth ", g, f"% >= {p.min_growth_pct}% with ", pct(F.col("ratio_current")), "% negative and ", c, " mentions"))
        .when((s == "DECLINING") & (F.col("growth_pct") <= -p.decline_pct), say("growth ", g, f"% <= -{p.decline_pct}%"))
        .when(s == "DECLINING", say("growth ", g, f"% <= -{p.soft_decline_pct}% with falling multi-week trend (soft decline; hard threshold is -{p.decline_pct}%)"))
        .when(s == "STABLE", say("growth ", g, f"% within (-{p.soft_decline_pct}%, {p.min_growth_pct}%) or decline lacks a falling weekly trend"))
    )


def iso_text(ts: Column) -> Column:
    """A time as 2026-06-01T10:20:30, with microseconds only if it has some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def calculation(p: Params = Params()) -> Column:
    """How the figures came about: the windows, three formulas with their numbers (fixed wording), and the thresholds in force."""
    c, pv, g = F.col("current").cast("string"), F.col("previous").cast("string"), number_text(F.col("growth_pct"))
    grown = F.when(F.col("growth_pct").isNotNull(), F.concat(F.lit("("), c, F.lit(" - "), pv, F.lit(") / "), pv, F.lit(" x 100 = "), g, F.lit("%")))
    grown = grown.when(F.col("current") > 0, "previous = 0 -> growth undefined, classified NEW").otherwise("no mentions in either window")
    neg = F.col("negative_current").cast("string")
    negative = F.when(F.col("current") > 0, F.concat(neg, F.lit(" / "), c, F.lit(" = "), number_text(rounded(F.col("ratio_current") * 100, 1)), F.lit("%"))).otherwise("no current mentions")
    priority = F.concat(neg, F.lit(" x "), F.format_string("%.2f", F.col("factor")), F.lit(" = "), number_text(F.col("priority")))
    start, end, before = (iso_text(F.col(x)) for x in ("current_start", "window_end", "previous_start"))
    limits = {"min_growth_pct": p.min_growth_pct, "min_negative_ratio": p.min_negative_ratio, "decline_pct": p.decline_pct, "soft_decline_pct": p.soft_decline_pct}
    thresholds = F.struct(F.col("min_mentions").alias("min_current_mentions"), F.col("min_evidence").alias("min_evidence_reviews"), *[F.lit(v).alias(k) for k, v in limits.items()])
    window = F.struct(F.array(start, end).alias("current"), F.array(before, start).alias("previous"))
    return F.struct(window.alias("window"), grown.alias("growth"), negative.alias("negative_ratio"), priority.alias("priority"), thresholds.alias("thresholds"))


def status_rank(s: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in STATUSES]), s) - 1


def radar(reviews: DataFrame, themes: DataFrame, p: Params = Params(), as_of: datetime | None = None) -> DataFrame:
    """The full report, in report order."""
    rows, one = located(reviews, p, as_of)
    found = evidence(rows, p).groupBy("theme_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "review_id"))), lambda x: x["review_id"]).alias("evidence_review_ids"))
    lifts = segment_lift(rows, p).join(themes.select("theme_id", "name"), "theme_id").withColumn("statement", association_text(F.col("name")))
    lifts = lifts.groupBy("theme_id").agg(F.sort_array(F.collect_list(F.struct("rank", "segment", "value", "theme_share", "overall_share", "lift", "support", "statement"))).alias("associations"))
    out = judged(rows, one, themes, p).join(found, "theme_id", "left").join(lifts, "theme_id", "left")
    out = out.withColumns(
        {
            "evidence_review_ids": F.coalesce("evidence_review_ids", F.array().cast("array<string>")),
            "reasons": F.array_compact(F.array(reason(p))),
            "calculation": calculation(p),
        }
    )
    return out.orderBy(status_rank(F.col("status")), F.desc("priority"), "theme_id")


def formula_text(p: Params = Params()) -> str:
    return f"priority = current_negative_mentions x (1 + clip(growth_pct / 100, 0, {p.max_growth_bonus}))  [NEW: x (1 + {p.max_growth_bonus})]"


def rules_text(p: Params = Params(), min_mentions: int = 30, min_evidence: int = 3) -> str:
    """The decision table in words, with the thresholds in force; one line a rule, in order of evaluation."""
    rules = [
        ("NO_DATA", "no mention in either window"),
        ("NOT_A_COMPLAINT", f"negative ratio (current window, or whole batch if that is empty) < {p.min_negative_ratio:g}"),
        ("INSUFFICIENT_EVIDENCE", f"current < {min_mentions} or negative evidence reviews < {min_evidence}"),
        ("INSUFFICIENT_EVIDENCE", "the batch does not reach back beyond the current window"),
        ("NEW", f"previous == 0 and current >= {min_mentions}"),
        ("EMERGING", f"growth >= {p.min_growth_pct:g}%"),
        ("DECLINING", f"growth <= -{p.decline_pct:g}%"),
        ("DECLINING", f"growth <= -{p.soft_decline_pct:g}%, weekly trend falling, and previous >= {min_mentions}"),
        ("STABLE", "otherwise"),
    ]
    return "\n".join(f"{k + 1}. {name}: {rule}" for k, (name, rule) in enumerate(rules))
