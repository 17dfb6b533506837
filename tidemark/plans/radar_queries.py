"""Radar and drift over the event stream, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numbers import sql_rounded as r
from tidemark.operators import drift, radar
from tidemark.plans.frames import REVIEWS, THEMES, reviews, themes

WEEK_US = 604_800_000_000
PLACED = f"""{REVIEWS}, {THEMES},
w AS (SELECT max(created_at) AS window_end, min(created_at) AS first_ts, count(created_at) AS dated FROM reviews),
a AS (SELECT *, window_end - INTERVAL 14 DAY AS current_start, window_end - INTERVAL 28 DAY AS previous_start,
  CAST(greatest(1, ceil((epoch_us(window_end) - epoch_us(first_ts)) / {WEEK_US}.0)) AS INTEGER) AS n_buckets,
  CASE WHEN dated >= 5000 THEN 30 ELSE least(30, greatest(8, CAST(round_even(dated * 0.015, 0) AS INTEGER))) END AS min_mentions,
  CASE WHEN dated < 200 THEN 2 ELSE 3 END AS min_evidence FROM w),
o AS (SELECT r.*, a.*, n_buckets * {WEEK_US}::BIGINT - (epoch_us(window_end) - epoch_us(created_at)) AS off FROM reviews r, a),
p AS (SELECT *, CASE WHEN off > 0 THEN least(n_buckets - 1, CAST(off // {WEEK_US} AS INTEGER)) END AS bucket,
  created_at > current_start AND created_at <= window_end AS in_current, created_at > previous_start AND created_at <= current_start AS in_previous FROM o)"""
DECIDED = f"""{PLACED},
c AS (SELECT theme_id, count(*) FILTER (WHERE in_current) AS current, count(*) FILTER (WHERE in_previous) AS previous,
  count(*) FILTER (WHERE in_current AND sentiment = 'negative') AS negative_current, count(*) FILTER (WHERE sentiment = 'negative') AS negative_all, count(*) AS total FROM p GROUP BY 1),
k AS (SELECT t.theme_id, b.bucket, count(p.theme_id) AS n FROM themes t CROSS JOIN (SELECT unnest(range(0, (SELECT n_buckets FROM a))) AS bucket) b
  LEFT JOIN p ON p.theme_id = t.theme_id AND p.bucket = b.bucket GROUP BY 1, 2),
s AS (SELECT theme_id, list(n ORDER BY bucket) AS weekly_counts, sum(n) AS tot, count(*) AS m, sum(n * bucket) AS mom FROM k GROUP BY 1),
tr AS (SELECT theme_id, weekly_counts, m, CASE WHEN m < 3 OR tot = 0 THEN NULL ELSE ((mom - tot * (m - 1) / 2.0) / (m * (m * m - 1) / 12.0)) / (tot / m) END AS rel FROM s),
d AS (SELECT t.theme_id, t.name, coalesce(c.current, 0) AS current, coalesce(c.previous, 0) AS previous, coalesce(c.negative_current, 0) AS negative_current,
  coalesce(c.total, 0) AS total, coalesce(c.negative_current / nullif(c.current, 0)::DOUBLE, 0.0::DOUBLE) AS ratio_current, coalesce(c.negative_all / nullif(c.total, 0)::DOUBLE, 0.0::DOUBLE) AS ratio_all,
  CASE WHEN c.previous > 0 THEN {r("(c.current - c.previous) / c.previous::DOUBLE * 100.0", 2)} END AS growth_pct,
  tr.weekly_counts, tr.m, tr.rel, CASE WHEN rel IS NULL THEN 'insufficient_periods' WHEN rel > 0.05 THEN 'rising' WHEN rel < -0.05 THEN 'falling' ELSE 'stable' END AS trend,
  a.* FROM themes t LEFT JOIN c USING (theme_id) JOIN tr USING (theme_id), a),
e AS (SELECT *, CASE WHEN previous = 0 AND current > 0 THEN 4.0 ELSE 1.0 + least(greatest(coalesce(growth_pct, 0) / 100.0, 0.0), 3.0) END AS factor,
  CASE WHEN current = 0 AND previous = 0 THEN 'NO_DATA'
    WHEN (CASE WHEN current > 0 THEN ratio_current ELSE ratio_all END) < 0.5 THEN 'NOT_A_COMPLAINT'
    WHEN current < min_mentions OR negative_current < min_evidence THEN 'INSUFFICIENT_EVIDENCE'
    WHEN first_ts > current_start THEN 'INSUFFICIENT_EVIDENCE' WHEN previous = 0 THEN 'NEW' WHEN growth_pct >= 50 THEN 'EMERGING' WHEN growth_pct <= -25 THEN 'DECLINING'
    WHEN growth_pct <= -15 AND trend = 'falling' AND previous >= min_mentions THEN 'DECLINING' ELSE 'STABLE' END AS status FROM d)"""

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("radar_status", f"WITH {DECIDED} SELECT theme_id, status, current, previous, negative_current, total, growth_pct, {r('ratio_current', 4)} AS negative_ratio, {r('ratio_all', 4)} AS negative_ratio_all FROM e")
def radar_status(spark, sf):
    return radar.decided(reviews(spark, sf), themes(spark, sf)).select("theme_id", "status", "current", "previous", "negative_current", "total", "growth_pct", "negative_ratio", "negative_ratio_all")


@query("radar_priority", f"WITH {DECIDED} SELECT theme_id, {r('negative_current * factor', 2)} AS priority, factor FROM e")
def radar_priority(spark, sf):
    return radar.decided(reviews(spark, sf), themes(spark, sf)).select("theme_id", "priority", "factor")


@query(
    "radar_growth_label",
    f"""WITH {DECIDED} SELECT theme_id, CASE WHEN previous = 0 AND current > 0 THEN 'NEW' WHEN growth_pct IS NULL THEN 'n/a'
    ELSE (CASE WHEN growth_pct > 0 THEN '+' WHEN growth_pct < 0 AND growth_pct >= -0.5 THEN '-' ELSE '' END) || CAST({r("growth_pct", 0)} AS BIGINT) || '%' END AS growth_label FROM e""",
)
def radar_growth_label(spark, sf):
    return radar.decided(reviews(spark, sf), themes(spark, sf)).select("theme_id", "growth_label")


@query("radar_weekly_buckets", f"WITH {PLACED}, k AS (SELECT t.theme_id, b.bucket, count(p.theme_id) AS n FROM themes t CROSS JOIN (SELECT unnest(range(0, (SELECT n_buckets FROM a))) AS bucket) b LEFT JOIN p ON p.theme_id = t.theme_id AND p.bucket = b.bucket GROUP BY 1, 2) SELECT theme_id, CAST(bucket AS INTEGER) AS bucket, n FROM k WHERE theme_id <> 'unused'")
def radar_weekly_buckets(spark, sf):
    return radar.weekly_counts(radar.placed(reviews(spark, sf))).select("theme_id", F.posexplode("weekly_counts").alias("bucket", "n"))


@query("radar_trend", f"WITH {DECIDED} SELECT theme_id, trend, {r('rel', 6)} AS slope FROM e")
def radar_trend(spark, sf):
    d = radar.decided(reviews(spark, sf), themes(spark, sf))
    total = F.aggregate("weekly_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("theme_id", "trend", radar.rounded(F.when((F.size("weekly_counts") >= 3) & (total > 0), radar.relative_slope(F.col("weekly_counts"))), 6).alias("slope"))


@query("radar_acceleration", f"WITH {DECIDED} SELECT theme_id, CASE WHEN m >= 3 AND weekly_counts[-3] <> 0 AND weekly_counts[-2] <> 0 THEN {r('((weekly_counts[-1] - weekly_counts[-2]) / weekly_counts[-2]::DOUBLE - (weekly_counts[-2] - weekly_counts[-3]) / weekly_counts[-3]::DOUBLE) * 100.0', 2)} END AS acceleration_pp FROM e")
def radar_acceleration(spark, sf):
    return radar.decided(reviews(spark, sf), themes(spark, sf)).select("theme_id", "acceleration_pp")


@query("radar_evidence_topk", f"WITH {PLACED} SELECT theme_id, review_id, CAST(row_number() OVER (PARTITION BY theme_id ORDER BY similarity DESC, confidence DESC, review_id) - 1 AS INTEGER) AS rank FROM p WHERE in_current AND sentiment = 'negative' QUALIFY rank < 5")
def radar_evidence_topk(spark, sf):
    return radar.evidence(radar.placed(reviews(spark, sf)))


@query(
    "radar_segment_lift",
    f"""WITH {PLACED}, l AS (SELECT theme_id, 'app_version' AS segment, app_version AS value FROM p WHERE in_current UNION ALL SELECT theme_id, 'platform', platform FROM p WHERE in_current),
    n AS (SELECT theme_id, segment, value, count(*) AS support FROM l GROUP BY ALL),
    x AS (SELECT n.*, support / sum(support) OVER (PARTITION BY theme_id, segment) AS ts, sum(support) OVER (PARTITION BY segment, value) / sum(support) OVER (PARTITION BY segment) AS os FROM n)
    SELECT theme_id, segment, value, {r("ts", 4)} AS theme_share, {r("os", 4)} AS overall_share, {r("ts / os", 2)} AS lift, support FROM x
    WHERE support >= 20 AND ts / os >= 1.01 QUALIFY row_number() OVER (PARTITION BY theme_id ORDER BY {r("ts / os", 2)} DESC, segment, value) <= 3""",
)
def radar_segment_lift(spark, sf):
    """With a lower bar than the report's, which these evenly spread events would never reach."""
    p = radar.Params(min_segment_lift=1.01)
    return radar.segment_lift(radar.placed(reviews(spark, sf)), p).select("theme_id", "segment", "value", "theme_share", "overall_share", "lift", "support")


@query("radar_windows", f"WITH {PLACED} SELECT window_end, current_start, previous_start, n_buckets, dated, min_mentions, min_evidence, first_ts <= current_start AS has_previous FROM a")
def radar_windows(spark, sf):
    return radar.anchors(reviews(spark, sf)).select("window_end", "current_start", "previous_start", "n_buckets", "dated", "min_mentions", "min_evidence", "has_previous")


@query("radar_order", f"WITH {DECIDED} SELECT theme_id, CAST(row_number() OVER (ORDER BY list_position(['NEW','EMERGING','STABLE','DECLINING','INSUFFICIENT_EVIDENCE','NOT_A_COMPLAINT','NO_DATA'], status), {r('negative_current * factor', 2)} DESC, theme_id) AS INTEGER) AS place FROM e")
def radar_order(spark, sf):
    from pyspark.sql import Window

    d = radar.decided(reviews(spark, sf), themes(spark, sf))
    return d.select("theme_id", F.row_number().over(Window.orderBy(radar.status_rank(F.col("status")), F.desc("priority"), "theme_id")).alias("place"))  # one row a theme


_SHARE = "(CASE WHEN current > 0 THEN ratio_current ELSE ratio_all END)"
_GATED = "CASE WHEN current < min_mentions THEN 'current mentions ' || current || ' < ' || min_mentions WHEN negative_current < min_evidence THEN 'negative evidence reviews ' || negative_current || ' < ' || min_evidence ELSE 'batch does not cover a full previous window' END"
_REASON = f"""CASE status WHEN 'NOT_A_COMPLAINT' THEN 'negative ratio ' || {r(_SHARE + " * 100", 1)} || '% < 50%' WHEN 'INSUFFICIENT_EVIDENCE' THEN {_GATED}
  WHEN 'NEW' THEN '0 mentions in previous window, ' || current || ' in current window (>= ' || min_mentions || ')'
  WHEN 'EMERGING' THEN 'growth ' || growth_pct || '% >= 50.0% with ' || {r("ratio_current * 100", 1)} || '% negative and ' || current || ' mentions'
  WHEN 'DECLINING' THEN CASE WHEN growth_pct <= -25 THEN 'growth ' || growth_pct || '% <= -25.0%' ELSE 'growth ' || growth_pct || '% <= -15.0% with falling multi-week trend (soft decline; hard threshold is -25.0%)' END
  WHEN 'STABLE' THEN 'growth ' || growth_pct || '% within (-15.0%, 50.0%) or decline lacks a falling weekly trend' ELSE '' END"""
_CALC = f"""CASE WHEN growth_pct IS NOT NULL THEN '(' || current || ' - ' || previous || ') / ' || previous || ' x 100 = ' || growth_pct || '%' WHEN current > 0 THEN 'previous = 0 -> growth undefined, classified NEW' ELSE 'no mentions in either window' END AS calc_growth,
  CASE WHEN current > 0 THEN negative_current || ' / ' || current || ' = ' || {r("ratio_current * 100", 1)} || '%' ELSE 'no current mentions' END AS calc_ratio,
  negative_current || ' x ' || format('{{:.2f}}', factor) || ' = ' || {r("negative_current * factor", 2)} AS calc_priority, strftime(current_start, '%Y-%m-%dT%H:%M:%S') AS window_from, min_mentions AS gate"""


@query(
    "radar_report",
    f"""WITH {DECIDED}, v AS (SELECT theme_id, review_id, row_number() OVER (PARTITION BY theme_id ORDER BY similarity DESC, confidence DESC, review_id) AS k FROM p WHERE in_current AND sentiment = 'negative' QUALIFY k <= 5),
    x AS (SELECT theme_id, string_agg(review_id, ',' ORDER BY k) AS evidence FROM v GROUP BY 1)
    SELECT theme_id, name, status, {r("negative_current * factor", 2)} AS priority, {_REASON} AS reasons, {_CALC}, coalesce(evidence, '') AS evidence, array_to_string(weekly_counts, ',') AS weekly, trend FROM e LEFT JOIN x USING (theme_id)""",
)
def radar_report(spark, sf):
    out = radar.radar(reviews(spark, sf), themes(spark, sf))
    return out.select(
        "theme_id", "name", "status", "priority", F.array_join("reasons", "; ").alias("reasons"), F.col("calculation.growth").alias("calc_growth"), F.col("calculation.negative_ratio").alias("calc_ratio"),
        F.col("calculation.priority").alias("calc_priority"), F.substring(F.col("calculation.window.current")[0], 1, 19).alias("window_from"), F.col("calculation.thresholds.min_current_mentions").alias("gate"),
        F.array_join("evidence_review_ids", ",").alias("evidence"), F.array_join(F.col("weekly_counts").cast("array<string>"), ",").alias("weekly"), "trend",
    )


@query("radar_associations")
def radar_associations(spark, sf):
    """What stands out in each theme, in words, with a lower bar than the report's."""
    out = radar.radar(reviews(spark, sf), themes(spark, sf), radar.Params(min_segment_lift=1.01))
    return out.select("theme_id", F.inline_outer("associations")).where("segment is not null")


@query(
    "radar_rules",
    f"""WITH {DECIDED}, n AS (SELECT status, count(*) AS n FROM e GROUP BY 1),
    x AS (SELECT * FROM (VALUES (1, 'NO_DATA'), (2, 'NOT_A_COMPLAINT'), (3, 'INSUFFICIENT_EVIDENCE'), (4, 'INSUFFICIENT_EVIDENCE'), (5, 'NEW'), (6, 'EMERGING'), (7, 'DECLINING'), (8, 'DECLINING'), (9, 'STABLE')) AS t(number, status))
    SELECT number, status, coalesce(n, 0) AS n_themes FROM x LEFT JOIN n USING (status)""",
)
def radar_rules(spark, sf):
    """The rules as they are printed, with the number of themes that have each rule's status now."""
    lines = F.split(F.lit(radar.rules_text()), "\n")
    rules = spark.range(1).select(F.explode(lines).alias("line")).select(F.split_part("line", F.lit("."), F.lit(1)).cast("int").alias("number"), F.regexp_extract("line", r"^\d+\. (\w+):", 1).alias("status"))
    now = radar.decided(reviews(spark, sf), themes(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))
    return rules.join(now, "status", "left").select("number", "status", F.coalesce("n", F.lit(0).cast("long")).alias("n_themes"))


def _dist(cats: str, counts: str) -> str:
    return f"""cats AS ({cats}), cnt AS ({counts}),
    f AS (SELECT cats.category, coalesce(ref_n, 0) AS ref_n, coalesce(cur_n, 0) AS cur_n FROM cats LEFT JOIN cnt USING (category)),
    s AS (SELECT *, CASE WHEN sum(ref_n) OVER () = 0 THEN 1.0 / count(*) OVER () ELSE ref_n / sum(ref_n) OVER () END AS rs, CASE WHEN sum(cur_n) OVER () = 0 THEN 1.0 / count(*) OVER () ELSE cur_n / sum(cur_n) OVER () END AS cs FROM f),
    q AS (SELECT *, greatest(rs, 1e-4) / sum(greatest(rs, 1e-4)) OVER () AS r, greatest(cs, 1e-4) / sum(greatest(cs, 1e-4)) OVER () AS c, (rs + cs) / 2 AS m FROM s),
    z AS (SELECT sum((c - r) * ln(c / r)) AS psi, sqrt(greatest((sum(CASE WHEN rs > 0 THEN rs * log2(rs / m) ELSE 0 END) + sum(CASE WHEN cs > 0 THEN cs * log2(cs / m) ELSE 0 END)) / 2, 0)) AS js, sum(ref_n)::BIGINT AS reference_n, sum(cur_n)::BIGINT AS current_n FROM q)"""


_SENT = _dist("SELECT unnest(['negative','neutral','positive']) AS category", "SELECT sentiment AS category, count(*) FILTER (WHERE in_previous) AS ref_n, count(*) FILTER (WHERE in_current) AS cur_n FROM p GROUP BY 1")
_THEME = _dist("SELECT theme_id AS category FROM themes UNION SELECT 'unassigned'", "SELECT coalesce(theme_id, 'unassigned') AS category, count(*) FILTER (WHERE in_previous) AS ref_n, count(*) FILTER (WHERE in_current) AS cur_n FROM p GROUP BY 1")
_VERDICT = f"SELECT {r('psi', 4)} AS value, {r('js', 4)} AS js_distance, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS status, reference_n, current_n FROM z"


@query("drift_psi_sentiment", f"WITH {PLACED}, {_SENT} {_VERDICT}")
def drift_psi_sentiment(spark, sf):
    rows = radar.placed(reviews(spark, sf))
    return drift.categorical(drift.window_counts(rows, F.col("sentiment")), drift.spine(spark, drift.SENTIMENTS))


def _theme_cats(spark, sf):
    return themes(spark, sf).select(F.col("theme_id").alias("category")).union(drift.spine(spark, ["unassigned"])).distinct()


@query("drift_psi_theme", f"WITH {PLACED}, {_THEME} {_VERDICT}")
def drift_psi_theme(spark, sf):
    rows = radar.placed(reviews(spark, sf))
    return drift.categorical(drift.window_counts(rows, F.coalesce("theme_id", F.lit("unassigned"))), _theme_cats(spark, sf))


@query("drift_top_changes", f"WITH {PLACED}, {_THEME}, y AS (SELECT category, rs, cs, {r('(cs - rs) * 100', 2)} AS change_pp FROM s) SELECT CAST(row_number() OVER (ORDER BY abs(change_pp) DESC, category) AS INTEGER) AS rank, category, {r('rs', 4)} AS reference_share, {r('cs', 4)} AS current_share, change_pp FROM y QUALIFY rank <= 5")
def drift_top_changes(spark, sf):
    rows = radar.placed(reviews(spark, sf))
    return drift.top_changes(drift.window_counts(rows, F.coalesce("theme_id", F.lit("unassigned"))), _theme_cats(spark, sf))


@query("drift_volume", f"WITH {PLACED}, v AS (SELECT count(*) FILTER (WHERE in_previous) / 14.0::DOUBLE AS a, count(*) FILTER (WHERE in_current) / 14.0::DOUBLE AS b FROM p) SELECT {r('a', 2)} AS reference_per_day, {r('b', 2)} AS current_per_day, {r('(b - a) / a', 4)} AS value, CASE WHEN abs((b - a) / a) >= 0.5 THEN 'significant' WHEN abs((b - a) / a) >= 0.2 THEN 'moderate' ELSE 'none' END AS status FROM v")
def drift_volume(spark, sf):
    rows = radar.placed(reviews(spark, sf)).agg(F.count_if("in_previous").alias("a"), F.count_if("in_current").alias("b"))
    return rows.select(drift.volume(F.col("a"), 14, F.col("b"), 14).alias("v")).select("v.*")


def _lengths(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select(F.when(F.col("doc_id") % 2 == 0, "ref").otherwise("cur").alias("side"), F.length("text").alias("length"))


_KS = """l AS (SELECT doc_id % 2 = 0 AS ref, length(text) AS n FROM documents), g AS (SELECT n, count(*) FILTER (WHERE ref) AS a, count(*) FILTER (WHERE NOT ref) AS b FROM l GROUP BY 1),
  u AS (SELECT n, sum(a) OVER (ORDER BY n) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY n) / sum(b) OVER () AS fb FROM g)"""


@query("drift_ks_d", f"WITH {_KS} SELECT {r('max(abs(fa - fb))', 6)} AS d, (SELECT sum(a)::BIGINT FROM g) AS n, (SELECT sum(b)::BIGINT FROM g) AS m FROM u")
def drift_ks_d(spark, sf):
    return drift.ks_statistic(_lengths(spark, sf)).select(drift.rounded(F.col("d"), 6).alias("d"), "n", "m")


@query("drift_ks_p")
def drift_ks_p(spark, sf):
    return drift.length_drift(drift.ks_statistic(_lengths(spark, sf))).select("value", "p_value", "status")


def _alone(dist: str, metric: str) -> str:
    return f"(WITH {dist} SELECT '{metric}' AS metric, {r('psi', 4)} AS value, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS status FROM z)"


_LENGTHS = """(WITH g AS (SELECT rating + 1 AS len, count(*) FILTER (WHERE in_previous) AS a, count(*) FILTER (WHERE in_current) AS b FROM p WHERE in_previous OR in_current GROUP BY 1),
  u AS (SELECT sum(a) OVER (ORDER BY len) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY len) / sum(b) OVER () AS fb FROM g) SELECT max(abs(fa - fb)) AS d FROM u)"""
_VOLUME = "SELECT count(*) FILTER (WHERE in_previous) / 14.0::DOUBLE AS a, count(*) FILTER (WHERE in_current) / 14.0::DOUBLE AS b FROM p"


@query(
    "drift_report",
    f"""WITH {PLACED}, vol AS ({_VOLUME}), ks AS (SELECT d FROM {_LENGTHS}), y AS (SELECT * FROM {_alone(_SENT, "sentiment")} UNION ALL SELECT * FROM {_alone(_THEME, "theme")}
      UNION ALL SELECT 'volume', {r("(b - a) / a", 4)}, CASE WHEN abs((b - a) / a) >= 0.5 THEN 'significant' WHEN abs((b - a) / a) >= 0.2 THEN 'moderate' ELSE 'none' END FROM vol
      UNION ALL SELECT 'review_length', {r("d", 4)}, CASE WHEN d < 0.1 THEN 'none' END FROM ks)
    SELECT *, CASE max(CASE status WHEN 'significant' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END) OVER () WHEN 2 THEN 'significant' WHEN 1 THEN 'moderate' ELSE 'none' END AS overall_status FROM y""",
)
def drift_report(spark, sf):
    """Lengths that lie close together, so that no p-value decides."""
    return drift.report(_sized(spark, sf), themes(spark, sf))


def _sized(spark, sf):
    return radar.placed(reviews(spark, sf)).withColumn("text_redacted", F.repeat(F.lit("x"), (F.col("rating") + 1).cast("int")))


@query(
    "drift_details",
    f"""WITH {PLACED}, vol AS ({_VOLUME}), ks AS (SELECT d FROM {_LENGTHS}),
    sz AS (WITH {_SENT} SELECT {r("psi", 4)} AS value, {r("js", 4)} AS js, reference_n::DOUBLE AS rn, current_n::DOUBLE AS cn FROM z), tz AS (WITH {_THEME} SELECT {r("psi", 4)} AS value, {r("js", 4)} AS js, reference_n::DOUBLE AS rn, current_n::DOUBLE AS cn FROM z),
    sc AS (WITH {_SENT} SELECT category, {r("(cs - rs) * 100", 2)} AS pp FROM s), tc AS (WITH {_THEME} SELECT category, {r("(cs - rs) * 100", 2)} AS pp FROM s)
    {" UNION ALL ".join(f"SELECT '{m}' AS metric, '{n}' AS name, {c} AS value FROM {t}" for m, t in (("sentiment", "sz"), ("theme", "tz")) for n, c in (("value", "value"), ("js_distance", "js"), ("reference_n", "rn"), ("current_n", "cn")))}
    {" ".join(f"UNION ALL (SELECT '{m}', 'change of ' || category, pp FROM {t} ORDER BY abs(pp) DESC, category LIMIT 5)" for m, t in (("sentiment", "sc"), ("theme", "tc")))}
    UNION ALL SELECT 'volume', 'reference_per_day', {r("a", 2)} FROM vol UNION ALL SELECT 'volume', 'current_per_day', {r("b", 2)} FROM vol UNION ALL SELECT 'volume', 'value', {r("(b - a) / a", 4)} FROM vol
    UNION ALL SELECT 'review_length', 'value', {r("d", 4)} FROM ks
    UNION ALL SELECT 'review_length', 'reference_mean', {r("avg(rating + 1) FILTER (WHERE in_previous)", 1)} FROM p UNION ALL SELECT 'review_length', 'current_mean', {r("avg(rating + 1) FILTER (WHERE in_current)", 1)} FROM p
    UNION ALL SELECT 'thresholds', * FROM (VALUES ('psi_moderate', 0.1::DOUBLE), ('psi_significant', 0.25), ('volume_moderate', 0.2), ('volume_significant', 0.5), ('ks_moderate', 0.1), ('ks_significant', 0.2), ('ks_alpha', 0.01)) AS t(n, v)""",
)
def drift_details(spark, sf):
    return drift.details(_sized(spark, sf), themes(spark, sf))


@query(
    "drift_weekly",
    f"""WITH {PLACED}, cats AS (SELECT unnest(['negative','neutral','positive']) AS category), wk AS (SELECT DISTINCT bucket FROM p WHERE bucket >= 2),
    f AS (SELECT wk.bucket, cats.category, (SELECT count(*) FROM p WHERE p.bucket < 2 AND p.sentiment = cats.category) AS ref_n, (SELECT count(*) FROM p WHERE p.bucket = wk.bucket AND p.sentiment = cats.category) AS cur_n FROM wk, cats),
    s AS (SELECT *, ref_n / sum(ref_n) OVER w AS rs, cur_n / sum(cur_n) OVER w AS cs FROM f WINDOW w AS (PARTITION BY bucket)),
    q AS (SELECT *, greatest(rs, 1e-4) / sum(greatest(rs, 1e-4)) OVER w AS r, greatest(cs, 1e-4) / sum(greatest(cs, 1e-4)) OVER w AS c FROM s WINDOW w AS (PARTITION BY bucket)),
    z AS (SELECT bucket, sum((c - r) * ln(c / r)) AS psi, sum(ref_n) AS rn, sum(cur_n) AS n FROM q GROUP BY 1)
    SELECT CAST(bucket + 1 AS INTEGER) AS week, n::BIGINT AS n, {r("psi", 4)} AS sentiment_value, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS sentiment_status,
    {r("(n / 7.0::DOUBLE - rn / 14.0::DOUBLE) / (rn / 14.0::DOUBLE)", 4)} AS volume_value FROM z""",
)
def drift_weekly(spark, sf):
    rows = radar.placed(reviews(spark, sf))
    return drift.weekly(rows, themes(spark, sf)).select("week", "n", "sentiment_value", "sentiment_status", "volume_value")


def _weekly_psi(cats: str, column: str, name: str) -> str:
    """SQL tables <name>z(bucket, psi, rn, n): each week against the first two."""
    return f"""{name}f AS (SELECT wk.bucket, c.category, (SELECT count(*) FROM p WHERE p.bucket < 2 AND {column} = c.category) AS ref_n, (SELECT count(*) FROM p WHERE p.bucket = wk.bucket AND {column} = c.category) AS cur_n FROM wk, ({cats}) AS c(category)),
    {name}s AS (SELECT *, ref_n / sum(ref_n) OVER w AS rs, cur_n / sum(cur_n) OVER w AS cs FROM {name}f WINDOW w AS (PARTITION BY bucket)),
    {name}q AS (SELECT *, greatest(rs, 1e-4) / sum(greatest(rs, 1e-4)) OVER w AS r, greatest(cs, 1e-4) / sum(greatest(cs, 1e-4)) OVER w AS c FROM {name}s WINDOW w AS (PARTITION BY bucket)),
    {name}z AS (SELECT bucket, sum((c - r) * ln(c / r)) AS psi, sum(ref_n) AS rn, sum(cur_n) AS n FROM {name}q GROUP BY 1)"""


_BAND = "CASE WHEN {0} >= {2} THEN 'significant' WHEN {0} >= {1} THEN 'moderate' ELSE 'none' END"


@query(
    "drift_weekly_full",
    f"""WITH {PLACED}, wk AS (SELECT DISTINCT bucket FROM p WHERE bucket >= 2), {_weekly_psi("SELECT unnest(['negative','neutral','positive'])", "p.sentiment", "u")}, {_weekly_psi("SELECT theme_id FROM themes UNION SELECT 'unassigned'", "coalesce(p.theme_id, 'unassigned')", "v")},
    y AS (SELECT bucket, uz.n, uz.psi AS sp, vz.psi AS tp, (uz.n / 7.0::DOUBLE - uz.rn / 14.0::DOUBLE) / (uz.rn / 14.0::DOUBLE) AS ch FROM uz JOIN vz USING (bucket)),
    x AS (SELECT CAST(bucket + 1 AS INTEGER) AS week, n::BIGINT AS n, {r("sp", 4)} AS sentiment_value, {_BAND.format("sp", 0.1, 0.25)} AS sentiment_status, {r("tp", 4)} AS theme_value, {_BAND.format("tp", 0.1, 0.25)} AS theme_status, {r("ch", 4)} AS volume_value, {_BAND.format("abs(ch)", 0.2, 0.5)} AS volume_status FROM y)
    SELECT *, CASE WHEN 'significant' IN (sentiment_status, theme_status, volume_status) THEN 'significant' WHEN 'moderate' IN (sentiment_status, theme_status, volume_status) THEN 'moderate' ELSE 'none' END AS overall_status FROM x""",
)
def drift_weekly_full(spark, sf):
    return drift.weekly(radar.placed(reviews(spark, sf)), themes(spark, sf))
