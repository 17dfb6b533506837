"""Themes, evaluation, views, store and brief over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.numbers import rounded, sql_rounded as r
from tidemark.operators import audit, brief, embedding, evaluate, radar, themes as th, views
from tidemark.plans.frames import DOCS, REVIEWS, THEMES, docs, reviews, table, texts, themes
from tidemark.shared import Stored, shared_dir
from tidemark.plans.radar_queries import DECIDED, PLACED

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- rollups ---------------------------------------------------------------------------------------------------------
ROLLED = f"""rolled AS (SELECT theme_id, count(*) AS size, count(*) FILTER (WHERE sentiment = 'negative') AS negative_count, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count,
  count(*) FILTER (WHERE sentiment = 'positive') AS positive_count, {r("100.0 * count(*) FILTER (WHERE sentiment = 'negative') / count(*)::DOUBLE", 1)} AS negative_pct,
  count(*) FILTER (WHERE sentiment = 'negative') / count(*)::DOUBLE >= 0.5 AS is_complaint, {r("avg(CASE WHEN rating <> 0 THEN rating END)", 2)} AS avg_rating FROM reviews GROUP BY 1)"""


@query("theme_rollup", f"WITH {REVIEWS}, {ROLLED} SELECT * FROM rolled")
def theme_rollup(spark, sf):
    return th.rollup(reviews(spark, sf))


@query(
    "overview_kpis",
    f"""WITH {REVIEWS}, {ROLLED}, b AS (SELECT count(*) AS total_reviews, {", ".join(f"count(*) FILTER (WHERE sentiment = '{s}') AS {s}_count" for s in ("negative", "neutral", "positive"))},
    {", ".join(r(f"100.0 * count(*) FILTER (WHERE sentiment = '{s}') / count(*)::DOUBLE", 1) + f" AS {s}_pct" for s in ("negative", "neutral", "positive"))},
    {r("avg(CASE WHEN rating <> 0 THEN rating END)", 2)} AS avg_rating, min(created_at) AS first_ts, max(created_at) AS last_ts FROM reviews)
    SELECT b.*, (SELECT count(*) FROM rolled) AS n_themes, (SELECT count(*) FROM rolled WHERE is_complaint) AS n_complaint_themes,
    (SELECT theme_id FROM rolled WHERE is_complaint ORDER BY negative_count DESC, theme_id LIMIT 1) AS top_complaint FROM b""",
)
def overview_kpis(spark, sf):
    rv = reviews(spark, sf)
    return th.overview(rv, th.rollup(rv))


@query("complaint_topk", f"WITH {REVIEWS}, {ROLLED} SELECT theme_id, negative_count FROM rolled WHERE is_complaint ORDER BY negative_count DESC, theme_id LIMIT 3")
def complaint_topk(spark, sf):
    return views.top_complaints(th.rollup(reviews(spark, sf)), 3).select("theme_id", "negative_count")


@query("segments_of_theme", f"WITH {REVIEWS} SELECT 'app_version' AS segment, app_version AS value, count(*) AS n FROM reviews WHERE theme_id = 'click' GROUP BY 2 UNION ALL SELECT 'platform', platform, count(*) FROM reviews WHERE theme_id = 'click' GROUP BY 2")
def segments_of_theme(spark, sf):
    return views.segments(reviews(spark, sf), "click")


# --- vectors ---------------------------------------------------------------------------------------------------------
_CENT = """u AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS x FROM u GROUP BY 1, 2),
  c AS (SELECT label, d, x / (sqrt(sum(x * x) OVER (PARTITION BY label)) + 1e-12) AS x FROM m),
  s AS (SELECT u.vec_id, u.label AS own, c.label, sum(u.x * c.x) AS sim FROM u JOIN c USING (d) GROUP BY 1, 2, 3)"""


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


@query("centroid", f"WITH {_CENT} SELECT label, CAST(d - 1 AS INTEGER) AS dim, {r('x', 6)} AS x FROM c")
def centroid(spark, sf):
    c = th.centroids(_vectors(spark, sf), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("dim", "x")).withColumn("x", rounded(F.col("x"), 6))


@query("coherence", f"WITH {_CENT} SELECT label, count(*) AS size, {r('avg(sim)', 4)} AS coherence FROM s WHERE own = label GROUP BY 1")
def coherence(spark, sf):
    v = _vectors(spark, sf)
    return th.coherence(v, "label", "embedding", th.centroids(v, "label", "embedding"))


@query("nearest_centroid", f"WITH {_CENT} SELECT vec_id, CASE WHEN sim >= 0.3 THEN label END AS near, {r('sim', 5)} AS sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1")
def nearest_centroid(spark, sf):
    v = _vectors(spark, sf)
    out = th.nearest(v, "embedding", th.centroids(v, "label", "embedding"), "label", 0.3)
    return out.select("vec_id", F.col("near_theme").cast("int").alias("near"), rounded(F.col("near_similarity"), 5).alias("sim"))


@query(
    "noise_assign",
    """WITH q AS (SELECT vec_id, embedding, CASE WHEN label < 6 THEN label + 1 END AS t FROM embeddings), u AS (SELECT t, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM q),
    m AS (SELECT t, d, avg(x) AS x FROM u WHERE t IS NOT NULL GROUP BY 1, 2), c AS (SELECT t, d, x / (sqrt(sum(x * x) OVER (PARTITION BY t)) + 1e-12) AS x FROM m),
    s AS (SELECT u.vec_id, u.t AS own, c.t, sum(u.x * c.x) AS sim FROM u JOIN c USING (d) GROUP BY 1, 2, 3), n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, t) = 1)
    SELECT vec_id, CASE WHEN own IS NOT NULL THEN 'cluster' WHEN sim >= 0.6 THEN 'nearest_centroid' ELSE 'unassigned' END AS kind, CASE WHEN own IS NOT NULL THEN 'theme_00' || own WHEN sim >= 0.6 THEN 'theme_00' || t END AS theme_id FROM n""",
)
def noise_assign(spark, sf):
    v = _vectors(spark, sf).withColumn("theme_rank", F.when(F.col("label") < 6, F.col("label") + 1)).drop("label")
    return th.assigned(v).select("vec_id", F.col("theme_assignment").alias("kind"), "theme_id")


@query("theme_ids", "SELECT label, 'theme_' || lpad(CAST(row_number() OVER (ORDER BY n DESC, label) AS VARCHAR), 3, '0') AS theme_id FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def theme_ids(spark, sf):
    n = _vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return n.select("label", F.format_string("theme_%03d", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).alias("theme_id"))  # one row a theme


@query("representatives", f"WITH {DOCS}, v AS (SELECT *, (_pos * 7919 % 1000) / 1000.0 AS sim FROM docs), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY theme_id, lower(text) ORDER BY sim DESC, review_id) = 1) SELECT theme_id, review_id, CAST(row_number() OVER (PARTITION BY theme_id ORDER BY sim DESC, review_id) - 1 AS INTEGER) AS rank FROM b QUALIFY rank < 5")
def representatives(spark, sf):
    d = docs(spark, sf).withColumn("sim", (F.col("_pos") * 7919 % 1000) / 1000.0)
    return th.representatives(d, "theme_id", "review_id", "text", "sim")


@query("theme_discover")
def theme_discover(spark, sf):
    v = _vectors(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return th.discover(v, "vec_id", "text")[1]


@query("embedding_values")
def embedding_values(spark, sf):
    """The singular values that the text vectors of all documents stand on, and the share of all squares that each holds."""
    held = Stored(texts(spark, sf, "text").select(embedding.places(F.col("text"), embedding.Settings().features).alias("places"))).read()
    values = embedding.fit(held).values
    total = held.where(F.size("places") > 0).count() or 1  # rows have unit length
    rows = [(i + 1, round(float(v), 3), round(float(v * v) / total, 5)) for i, v in enumerate(values)]  # one a component
    return spark.createDataFrame(rows, "component int, value double, share double")


@query("theme_pca")
def theme_pca(spark, sf):
    """Twenty components; a component's sign is free."""
    return th.reduced(_vectors(spark, sf), "embedding", 20).select("vec_id", F.transform("reduced", lambda x: rounded(x, 6)).alias("reduced"))


@query("theme_pca_lengths", f"WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT d, avg(x) AS mean FROM u GROUP BY 1) SELECT vec_id, {r('sum((x - mean) * (x - mean))', 6)} AS square FROM u JOIN m USING (d) GROUP BY 1")
def theme_pca_lengths(spark, sf):
    """All components together keep every row's distance from the mean."""
    v = _vectors(spark, sf)
    whole = th.reduced(v, "embedding", len(v.select("embedding").first()[0]))
    return whole.select("vec_id", rounded(th.dot(F.col("reduced"), F.col("reduced")), 6).alias("square"))


@query("theme_merge", "WITH n AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS k FROM embeddings GROUP BY 1) SELECT vec_id, CAST(k AS INTEGER) AS theme_rank FROM embeddings JOIN n USING (label)")
def theme_merge(spark, sf):
    """The labels' centroids are too far apart to be merged, so themes are the labels by size; merging itself is tested on small vectors."""
    return th.merge_micro(_vectors(spark, sf).withColumnRenamed("label", "micro")).select("vec_id", "theme_rank")


def _leaning(spark, sf, by: float = 3.0) -> DataFrame:
    """The vectors drawn towards an axis of their label, so that labels are themes."""
    v = _vectors(spark, sf)
    lean = F.transform("embedding", lambda x, i: (x.cast("double") + F.when(i == F.col("label"), by).otherwise(0.0)).cast("float"))
    return v.withColumn("embedding", lean)


@query(
    "theme_merge_parts",
    """WITH u AS (SELECT label * 4 + vec_id % 4 AS m, vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x, label FROM embeddings),
  l AS (SELECT m, d, avg(CAST(x + CASE WHEN d - 1 = label THEN 3.0 ELSE 0.0 END AS FLOAT)::DOUBLE) AS x FROM u GROUP BY ALL), c AS (SELECT m, d, x / sqrt(sum(x * x) OVER (PARTITION BY m)) AS x FROM l),
  e AS (SELECT a.m AS x, b.m AS y FROM c a JOIN c b USING (d) GROUP BY ALL HAVING sum(a.x * b.x) >= 0.65),
  t AS (SELECT x AS m, min(y) AS g FROM e GROUP BY 1),
  n AS (SELECT g, row_number() OVER (ORDER BY count(*) DESC, g) AS k FROM embeddings JOIN t ON label * 4 + vec_id % 4 = t.m GROUP BY 1)
  SELECT vec_id, CAST(k AS INTEGER) AS theme_rank FROM embeddings JOIN t ON label * 4 + vec_id % 4 = t.m JOIN n USING (g)""",
)
def theme_merge_parts(spark, sf):
    """Four parts of each label are merged again. All parts of a label are alike and no others are, so the groups are those of the pairs."""
    v = _leaning(spark, sf).withColumn("micro", (F.col("label") * 4 + F.col("vec_id") % 4).cast("int"))
    return th.merge_micro(v).select("vec_id", "theme_rank")


@query("theme_grid")
def theme_grid(spark, sf):
    """Six settings of discovery on one reduction and two spanning trees."""
    return th.grid(_leaning(spark, sf, 0.7), "label", (5, 15, 40), (3, 8))


# --- words -----------------------------------------------------------------------------------------------------------
_STOP = "[" + ", ".join(f"'{w}'" for w in tx.DOMAIN_STOPWORDS) + "]"
_WORDS = f"w AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[a-z][a-z]+'), lambda x: NOT list_contains({_STOP}, x)) AS ws FROM documents)"
_STEM = "CASE WHEN x LIKE '%ing' AND length(x) > 6 THEN left(x, -3) WHEN x LIKE '%ed' AND length(x) > 5 THEN left(x, -2) WHEN x LIKE '%es' AND length(x) > 5 THEN left(x, -2) WHEN x LIKE '%s' AND length(x) > 4 THEN left(x, -1) ELSE x END"


@query("doc_frequency", f"WITH {_WORDS}, s AS (SELECT DISTINCT doc_id, {_STEM} AS stem FROM (SELECT doc_id, unnest(ws) AS x FROM w)) SELECT stem, count(*) AS df FROM s GROUP BY 1")
def doc_frequency(spark, sf):
    d = texts(spark, sf, "doc_id", "text")
    words = d.select("doc_id", F.explode(F.array_distinct(F.transform(tx.tokens(F.col("text"), tx.DOMAIN_STOPWORDS), tx.stem))).alias("stem"))
    return words.groupBy("stem").agg(F.count("*").alias("df"))


@query(
    "ctfidf_terms",
    f"""WITH {_WORDS}, t AS (SELECT lang, unnest(ws) AS term FROM w UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
    f AS (SELECT lang, term, count(*) AS tf FROM t GROUP BY 1, 2), c AS (SELECT lang, sum(tf) AS words FROM f GROUP BY 1),
    g AS (SELECT lang, term, tf, sum(tf) OVER (PARTITION BY term) AS freq FROM f),
    z AS (SELECT g.lang, term, {r("tf / words * ln(1 + (SELECT avg(words) FROM c) / freq)", 9)} AS score FROM g JOIN c USING (lang))
    SELECT lang, term, score FROM z QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) <= 24""",
)
def ctfidf_terms(spark, sf):
    s = th.ctfidf(texts(spark, sf, "doc_id", "lang", "text"), "lang", "text", tx.DOMAIN_STOPWORDS).withColumn("score", rounded(F.col("score"), 9))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "term"))).where("k <= 24").drop("k")


@query("keywords")
def keywords(spark, sf):
    return th.keywords(th.ctfidf(texts(spark, sf, "doc_id", "lang", "text"), "lang", "text", tx.stop_words()), "lang")


@query(
    "coverage_stems",
    f"""WITH {_WORDS}, s AS (SELECT DISTINCT doc_id, lang, {_STEM} AS stem FROM (SELECT doc_id, lang, unnest(ws) AS x FROM w)), n AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1),
    h AS (SELECT lang, stem, count(*) AS dc, sum(count(*)) OVER (PARTITION BY stem) AS da FROM s GROUP BY 1, 2), z AS (SELECT h.lang, stem, dc / size AS cov, dc / size * ln((dc / size) / (da / (SELECT count(*) FROM documents))) AS score FROM h JOIN n USING (lang))
    SELECT lang, stem, {r("cov", 6)} AS cov, {r("score", 6)} AS score FROM z WHERE cov >= 0.10""",
)
def coverage_stems(spark, sf):
    return th.coverage(texts(spark, sf, "doc_id", "lang", "text"), "lang", "doc_id", "text", tx.DOMAIN_STOPWORDS).select("lang", "stem", rounded(F.col("cov"), 6).alias("cov"), rounded(F.col("score"), 6).alias("score"))


@query("coverage_names")
def coverage_names(spark, sf):
    return th.names(texts(spark, sf, "doc_id", "lang", "text"), "lang", "doc_id", "text", tx.stop_words())


@query(
    "coverage_domain_names",
    f"""WITH {_WORDS}, a AS (SELECT doc_id, lang, unnest(ws) AS x FROM w), s AS (SELECT DISTINCT doc_id, lang, {_STEM} AS stem FROM a), n AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1),
    h AS (SELECT lang, stem, count(*) AS dc, sum(count(*)) OVER (PARTITION BY stem) AS da FROM s GROUP BY 1, 2), z AS (SELECT h.lang, stem, dc / size AS cov, dc / size * ln((dc / size) / (da / (SELECT count(*) FROM documents))) AS score FROM h JOIN n USING (lang)),
    t AS (SELECT * FROM z WHERE cov >= 0.10 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, cov DESC, stem DESC) <= 2),
    u AS (SELECT {_STEM} AS stem, x, count(*) AS n FROM a GROUP BY 1, 2), v AS (SELECT stem, x FROM u QUALIFY row_number() OVER (PARTITION BY stem ORDER BY n DESC, x) = 1),
    k AS (SELECT t.*, v.x, row_number() OVER (PARTITION BY lang ORDER BY score DESC, cov DESC, t.stem DESC) AS r FROM t JOIN v USING (stem)),
    b AS (SELECT lang, max(CASE WHEN r = 1 THEN x END) AS a, max(CASE WHEN r = 2 THEN x END) AS b, max(CASE WHEN r = 1 THEN score END) AS sa, max(CASE WHEN r = 2 THEN score END) AS sb FROM k GROUP BY 1)
    SELECT n.lang, coalesce(upper(a[1]) || a[2:] || CASE WHEN sb >= 0.35 * sa THEN ' ' || upper(b.b[1]) || b.b[2:] ELSE '' END, 'Unnamed Theme') AS name FROM n LEFT JOIN b USING (lang)""",
)
def coverage_domain_names(spark, sf):
    """Names of themes, with the domain's stop words only."""
    return th.names(texts(spark, sf, "doc_id", "lang", "text"), "lang", "doc_id", "text", tx.DOMAIN_STOPWORDS)


# --- evaluation ------------------------------------------------------------------------------------------------------
def _prf(cls: str, pred: str, cond: str = "true") -> str:
    tp, pp, ap = (f"count(*) FILTER (WHERE {c})::DOUBLE" for c in (f"{cond} AND {pred} = '{cls}' AND truth = '{cls}'", f"{cond} AND {pred} = '{cls}'", f"{cond} AND truth = '{cls}'"))
    p, q = f"coalesce({tp} / nullif({pp}, 0), 0)", f"coalesce({tp} / nullif({ap}, 0), 0)"
    return f"SELECT '{cls}' AS class, {r(p, 4)} AS precision, {r(q, 4)} AS recall, {r(f'coalesce(2 * {p} * {q} / nullif({p} + {q}, 0), 0)', 4)} AS f1, count(*) FILTER (WHERE {cond} AND truth = '{cls}') AS support FROM reviews"


_THREE = " UNION ALL ".join(_prf(c, "sentiment") for c in ("negative", "neutral", "positive"))


@query("eval_prf", f"WITH {REVIEWS} {_THREE}")
def eval_prf(spark, sf):
    return evaluate.per_class(reviews(spark, sf), "truth", "sentiment")


@query("eval_summary", f"WITH {REVIEWS}, c AS ({_THREE}) SELECT count(*) AS n, {r("count(*) FILTER (WHERE truth = sentiment) / count(*)::DOUBLE", 4)} AS accuracy, (SELECT {r('sum(f1) / 3', 4)} FROM c) AS macro_f1, (SELECT {r('sum(recall) / 3', 4)} FROM c) AS macro_recall FROM reviews")
def eval_summary(spark, sf):
    return evaluate.summary(reviews(spark, sf), "truth", "sentiment")


@query("confusion", f"WITH {REVIEWS}, t AS (SELECT unnest(['negative', 'neutral', 'positive']) AS truth) SELECT t.truth, {', '.join(f"count(*) FILTER (WHERE r.sentiment = '{c}') AS {c}" for c in ('negative', 'neutral', 'positive'))} FROM t LEFT JOIN reviews r ON r.truth = t.truth GROUP BY 1")
def confusion(spark, sf):
    return evaluate.confusion(reviews(spark, sf), "truth", "sentiment")


_P3 = "CASE WHEN p_negative = greatest(p_negative, p_neutral, p_positive) THEN 'negative' WHEN p_neutral = greatest(p_negative, p_neutral, p_positive) THEN 'neutral' ELSE 'positive' END"
_BINARY = f"x AS (SELECT truth, {_P3} AS p3, CASE WHEN p_positive > p_negative THEN 'positive' ELSE 'negative' END AS nb FROM reviews)"


def _by_choice(name: str, choices: dict[str, str]) -> str:
    """SQL for the scores of several ways to predict: l(name, truth, pred) to one row a way, macro figures over the two classes."""
    rows = " UNION ALL ".join(f"SELECT '{k}' AS {name}, truth, {pred} AS pred FROM x" for k, pred in choices.items())
    tp, pp, ap = "count(*) FILTER (WHERE pred = cls AND truth = cls)::DOUBLE", "count(*) FILTER (WHERE pred = cls)", "count(*) FILTER (WHERE truth = cls)"
    return f"""l AS ({rows}), k AS (SELECT unnest(['negative', 'positive']) AS cls),
    m AS (SELECT {name}, cls, coalesce({tp} / nullif({pp}, 0), 0) AS p, coalesce({tp} / nullif({ap}, 0), 0) AS q FROM l, k WHERE pred IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT {name}, {r("sum(f1) / 2", 4)} AS macro_f1, {r("sum(q4) / 2", 4)} AS macro_recall FROM (SELECT {name}, {r("coalesce(2 * p * q / nullif(p + q, 0), 0)", 4)} AS f1, {r("q", 4)} AS q4 FROM m) GROUP BY 1),
    o AS (SELECT {name}, count(pred) AS n, {r("count(*) FILTER (WHERE pred = truth) / count(pred)::DOUBLE", 4)} AS accuracy, {r("count(pred) / count(*)::DOUBLE", 4)} AS coverage FROM l GROUP BY 1)
    SELECT * FROM o JOIN f USING ({name})"""


_STRATEGIES = {
    "A_neutral_to_negative": "CASE WHEN p3 = 'neutral' THEN 'negative' ELSE p3 END",
    "B_neutral_to_positive": "CASE WHEN p3 = 'neutral' THEN 'positive' ELSE p3 END",
    "C_nearest_binary": "nb",
    "D_exclude_neutral": "CASE WHEN p3 <> 'neutral' THEN p3 END",
}


@query("neutral_strategies", f"WITH {REVIEWS}, {_BINARY}, {_by_choice('strategy', _STRATEGIES)}")
def neutral_strategies(spark, sf):
    return evaluate.neutral_strategies(reviews(spark, sf))


@query("binary_scorings", f"WITH {REVIEWS}, {_BINARY}, {_by_choice('scoring', {'binary_forced': 'nb', 'strict_3class': 'p3', 'abstain': _STRATEGIES['D_exclude_neutral']})}")
def binary_scorings(spark, sf):
    return evaluate.binary_scorings(reviews(spark, sf))


@query("threshold_tune", f"WITH {REVIEWS}, g AS (SELECT (k * 5 + 50) / 1000.0::DOUBLE AS t FROM range(181) x(k)), a AS (SELECT t, avg(CASE WHEN (p_positive / greatest(p_positive + p_negative, 1e-12) > t) = (truth = 'positive') THEN 1.0 ELSE 0.0 END) AS acc FROM reviews, g GROUP BY 1) SELECT t AS threshold, {r('acc', 4)} AS val_accuracy FROM a ORDER BY round(acc, 9) DESC, abs(t - 0.5), t LIMIT 1")
def threshold_tune(spark, sf):
    return evaluate.tune_threshold(reviews(spark, sf))


@query("mcnemar", f"WITH {REVIEWS}, x AS (SELECT truth, sentiment AS a, CASE WHEN p_positive > p_negative THEN 'positive' ELSE 'negative' END AS b FROM reviews), y AS (SELECT count(*) FILTER (WHERE a = truth AND b <> truth) AS only_a, count(*) FILTER (WHERE a <> truth AND b = truth) AS only_b FROM x) SELECT only_a, only_b, {r('power(abs(only_a - only_b) - 1, 2) / (only_a + only_b)', 4)} AS chi2 FROM y")
def mcnemar(spark, sf):
    return evaluate.mcnemar(reviews(spark, sf).withColumn("b", evaluate.nearest_binary()), "truth", "sentiment", "b")


@query("confidence_bins", f"WITH {REVIEWS} SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, {r("count(*) FILTER (WHERE truth = sentiment) / count(*)::DOUBLE", 4)} AS accuracy FROM reviews GROUP BY 1")
def confidence_bins(spark, sf):
    return evaluate.confidence_bins(reviews(spark, sf), "truth", "sentiment", "confidence")


_CELLS = "cells AS (SELECT quality AS t, toxic AS c, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), a AS (SELECT t, sum(n) AS n FROM cells GROUP BY 1), b AS (SELECT c, sum(n) AS n, max(n) AS top FROM cells GROUP BY 1), k AS (SELECT sum(n) AS nn, sum(n * (n - 1) / 2) AS idx FROM cells)"


@query(
    "clustering_scores",
    f"""WITH {_CELLS}, q AS (SELECT nn, idx, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb, (SELECT sum(top) FROM b) AS top, (SELECT -sum(n / nn * ln(n / nn)) FROM a) AS ht, (SELECT -sum(n / nn * ln(n / nn)) FROM b) AS hc,
    (SELECT sum(cells.n / nn * ln(nn * cells.n / (a.n * b.n))) FROM cells JOIN a USING (t) JOIN b USING (c)) AS mi FROM k)
    SELECT {r("(idx - pa * pb / (nn * (nn - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (nn * (nn - 1) / 2))", 4)} AS ari, {r("2 * mi / (ht + hc)", 4)} AS nmi, {r("mi / ht", 4)} AS homogeneity, {r("mi / hc", 4)} AS completeness, {r("top / nn", 4)} AS weighted_purity FROM q""",
)
def clustering_scores(spark, sf):
    return evaluate.clustering_scores(table(spark, sf, "labels"), "quality", "toxic")


_HIT = {**{"all": "true", "short": "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) <= 4", "elongated": "regexp_matches(lower(coalesce(text, '')), '" + "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz") + "')"}, **{k: f"regexp_matches(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}')" for k, p in evaluate.ERROR_CATEGORIES.items() if k != "elongated"}}


@query(
    "error_rates",
    f"""WITH x AS (SELECT text, quality <> toxic AS wrong FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
    c AS ({" UNION ALL ".join(f"SELECT '{k}' AS category, count(*) AS n, count(*) FILTER (WHERE wrong) AS errors FROM x WHERE {h}" for k, h in _HIT.items())})
    SELECT category, n, {r("n / (SELECT n FROM c WHERE category = 'all')::DOUBLE", 4)} AS share, {r("errors / n::DOUBLE", 4)} AS error_rate FROM c WHERE n > 0""",
)
def error_rates(spark, sf):
    """Quality read as a prediction of toxicity, by category of the text."""
    d = table(spark, sf, "documents").select("doc_id", evaluate.error_categories(F.col("text")).alias("categories")).join(table(spark, sf, "labels"), "doc_id")
    return evaluate.error_rates(d, "categories", "toxic", "quality")


@query("purity", f"WITH x AS (SELECT source, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS all_n FROM documents GROUP BY 1, 2) SELECT source, lang AS majority, n, {r('n / all_n', 4)} AS purity FROM x QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1")
def purity(spark, sf):
    return evaluate.majority(table(spark, sf, "documents"), "source", "lang")


@query("label_agreement", f"SELECT count(*) AS n, {r('count(*) FILTER (WHERE quality = toxic) / count(*)::DOUBLE', 4)} AS agreement FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def label_agreement(spark, sf):
    return evaluate.agreement(table(spark, sf, "labels"), "quality", "toxic")


@query(
    "theme_recovery",
    f"""WITH p AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL AND lang <> 'invalid'), c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT DISTINCT lang FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1)), j AS (SELECT p.lang, g.lang IS NOT NULL AS got FROM p LEFT JOIN g USING (lang))
    SELECT coalesce(string_agg(lang, ',' ORDER BY lang), '') AS planted, coalesce(string_agg(lang, ',' ORDER BY lang) FILTER (WHERE got), '') AS recovered,
    coalesce(string_agg(lang, ',' ORDER BY lang) FILTER (WHERE NOT got), '') AS missing, {r("count(*) FILTER (WHERE got) / greatest(count(*), 1)::DOUBLE", 4)} AS theme_recall FROM j""",
)
def theme_recovery(spark, sf):
    out = evaluate.theme_recovery(table(spark, sf, "documents"), "lang", "source")
    return out.select(*[F.array_join(c, ",").alias(c) for c in ("planted", "recovered", "missing")], "theme_recall")


@query("best_run", "SELECT source AS run, (count(*) % 3) / 10.0::DOUBLE AS val_macro_recall, (sum(doc_id) % 97) / 97.0::DOUBLE AS test_macro_recall FROM documents GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1")
def best_run(spark, sf):
    """Sources as runs, with many ties on validation recall."""
    runs = table(spark, sf, "documents").groupBy(F.col("source").alias("run")).agg((F.count("*") % 3 / 10.0).alias("val_macro_recall"), (F.sum("doc_id") % 97 / 97.0).alias("test_macro_recall"))
    return evaluate.best_run(runs)


# --- views -----------------------------------------------------------------------------------------------------------
@query("reviews_page", f"WITH {REVIEWS} SELECT review_id, created_at, theme_id FROM reviews ORDER BY created_at DESC NULLS LAST, review_id LIMIT 25 OFFSET 50")
def reviews_page(spark, sf):
    return views.page(reviews(spark, sf), 25, 50).select("review_id", "created_at", "theme_id")


@query("reviews_filtered_page", f"WITH {REVIEWS} SELECT review_id, created_at FROM reviews WHERE theme_id = 'error' AND sentiment = 'negative' ORDER BY created_at DESC NULLS LAST, review_id LIMIT 25")
def reviews_filtered_page(spark, sf):
    return views.page(views.matching(reviews(spark, sf), "error", "negative")).select("review_id", "created_at")


@query("reviews_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the an')")
def reviews_search(spark, sf):
    return views.matching(table(spark, sf, "documents"), q="The An", text="text").select("doc_id")


@query("reviews_search_escaped", "SELECT doc_id FROM documents WHERE contains(text, '%') OR contains(text, '_')")
def reviews_search_escaped(spark, sf):
    d = table(spark, sf, "documents")
    return views.matching(d, q="%", text="text").select("doc_id").union(views.matching(d, q="_", text="text").select("doc_id")).distinct()


@query("reviews_total", f"WITH {REVIEWS} SELECT count(*) AS n FROM reviews WHERE sentiment = 'neutral'")
def reviews_total(spark, sf):
    return views.total(views.matching(reviews(spark, sf), sentiment="neutral"))


@query("review_theme_names", f"WITH {REVIEWS}, {THEMES} SELECT review_id, name AS theme_name FROM reviews LEFT JOIN themes USING (theme_id)")
def review_theme_names(spark, sf):
    return views.public(reviews(spark, sf), themes(spark, sf)).select("review_id", "theme_name")


def _listed(spark, sf) -> DataFrame:
    d = radar.decided(reviews(spark, sf), themes(spark, sf))
    return th.rollup(reviews(spark, sf)).join(d.select("theme_id", "name", "priority", "growth_pct", "status"), "theme_id").withColumn("keywords", F.array("theme_id"))


_LISTED = f"listed AS (SELECT rolled.*, e.name, {r('negative_current * factor', 2)} AS priority, growth_pct, status FROM rolled JOIN e USING (theme_id))"


@query("theme_search", f"WITH {DECIDED}, {ROLLED}, {_LISTED} SELECT theme_id, name FROM listed WHERE contains(lower(name), 'i')")
def theme_search(spark, sf):
    return views.themes_listed(_listed(spark, sf), q="I").select("theme_id", "name")


@query("theme_sort", f"WITH {DECIDED}, {ROLLED}, {_LISTED} SELECT theme_id, growth_pct FROM listed WHERE is_complaint ORDER BY growth_pct DESC NULLS LAST, theme_id LIMIT 3")
def theme_sort(spark, sf):
    return views.themes_listed(_listed(spark, sf), True, "growth_pct").select("theme_id", "growth_pct").limit(3)


@query("issues_by_status", f"WITH {DECIDED} SELECT theme_id, status FROM e WHERE status IN ('STABLE', 'NO_DATA', 'EMERGING')")
def issues_by_status(spark, sf):
    return views.issues_listed(radar.decided(reviews(spark, sf), themes(spark, sf)), "STABLE,NO_DATA,EMERGING").select("theme_id", "status")


_EVID = "ev AS (SELECT theme_id, review_id, 'radar_evidence' AS kind, CAST(row_number() OVER (PARTITION BY theme_id ORDER BY similarity DESC, confidence DESC, review_id) - 1 AS INTEGER) AS rank FROM p WHERE in_current AND sentiment = 'negative' QUALIFY rank < 5)"


def _evidence(spark, sf) -> DataFrame:
    return radar.evidence(radar.placed(reviews(spark, sf))).withColumn("kind", F.lit("radar_evidence"))


@query("evidence_join", f"WITH {PLACED}, {_EVID} SELECT ev.review_id, ev.rank, r.created_at, r.sentiment FROM ev JOIN reviews r USING (review_id) WHERE ev.theme_id = 'view'")
def evidence_join(spark, sf):
    return views.evidence_of(_evidence(spark, sf), reviews(spark, sf), "view").select("review_id", "rank", "created_at", "sentiment")


@query("orphan_links", f"WITH {PLACED}, {_EVID} SELECT ev.theme_id, ev.review_id FROM ev WHERE review_id NOT IN (SELECT 'R' || event_id FROM events WHERE event_id % 2 = 0)")
def orphan_links(spark, sf):
    half = reviews(spark, sf).where(F.substring("review_id", 2, 20).cast("long") % 2 == 0)
    return audit.orphans(_evidence(spark, sf), half).select("theme_id", "review_id")


@query("traceability_problems", f"WITH {PLACED}, {_EVID}, w2 AS (SELECT CASE WHEN theme_id = 'view' THEN 'click' ELSE theme_id END AS theme_id, review_id, kind, rank FROM ev) SELECT w2.theme_id, w2.review_id, CASE WHEN r.theme_id <> w2.theme_id THEN w2.theme_id || ': evidence ' || w2.review_id || ' belongs to ' || r.theme_id END AS problem FROM w2 JOIN reviews r USING (review_id)")
def traceability_problems(spark, sf):
    wrong = _evidence(spark, sf).withColumn("theme_id", F.when(F.col("theme_id") == "view", "click").otherwise(F.col("theme_id")))
    return audit.checked(wrong, reviews(spark, sf)).select("theme_id", "review_id", "problem")


@query(
    "traceability",
    f"""WITH {PLACED}, {_EVID}, l AS (SELECT CASE WHEN theme_id = 'view' THEN 'click' ELSE theme_id END AS theme_id, review_id FROM ev), j AS (SELECT l.theme_id <> r.theme_id AS bad FROM l JOIN reviews r USING (review_id))
    SELECT count(*) AS links_checked, count(*) FILTER (WHERE bad) AS n_problems, (SELECT count(*) FROM reviews WHERE rating = 5) AS residual, 'FAILED' AS status FROM j""",
)
def traceability(spark, sf):
    """Links of one theme moved to another, and an address left in the texts of five-star reviews."""
    wrong = _evidence(spark, sf).withColumn("theme_id", F.when(F.col("theme_id") == "view", "click").otherwise(F.col("theme_id")))
    rv = reviews(spark, sf).withColumn("text_redacted", F.when(F.col("rating") == 5, "write to a.b@example.org").otherwise("fine [EMAIL]"))
    return audit.traceability(wrong, rv)


@query("traceability_of_sound_links", f"WITH {PLACED}, {_EVID} SELECT count(*) AS links_checked, count(*) FILTER (WHERE r.theme_id <> ev.theme_id OR r.sentiment <> 'negative') AS n_problems, 0::BIGINT AS residual, 'PASS' AS status FROM ev JOIN reviews r USING (review_id)")
def traceability_of_sound_links(spark, sf):
    return audit.traceability(_evidence(spark, sf), reviews(spark, sf))


@query("stored_recount", f"WITH {REVIEWS}, {ROLLED} SELECT theme_id, CASE WHEN theme_id = 'click' THEN size + 1 ELSE size END AS size FROM rolled WHERE theme_id IN ('click', 'view')")
def stored_recount(spark, sf):
    """A stored rollup with a wrong size and a wrong count of negatives."""
    rv = reviews(spark, sf)
    stored = th.rollup(rv).withColumns({"size": F.col("size") + (F.col("theme_id") == "click").cast("long"), "negative_count": F.col("negative_count") - (F.col("theme_id") == "view").cast("long")})
    return audit.recomputed(rv, stored).select("theme_id", "size")


@query("review_detail", f"WITH {REVIEWS} SELECT review_id, theme_id, sentiment FROM reviews WHERE review_id = 'R77'")
def review_detail(spark, sf):
    return views.review_detail(reviews(spark, sf), _evidence(spark, sf), "R77").select("review_id", "theme_id", "sentiment")


@query("window_buckets", f"WITH {PLACED}, k AS (SELECT t.theme_id, b.bucket, count(p.theme_id) AS n FROM themes t CROSS JOIN (SELECT unnest(range(0, (SELECT n_buckets FROM a))) AS bucket) b LEFT JOIN p ON p.theme_id = t.theme_id AND p.bucket = b.bucket GROUP BY 1, 2) SELECT theme_id, CAST(bucket AS INTEGER) AS bucket, n, bucket >= (SELECT n_buckets FROM a) - 2 AS in_window FROM k WHERE theme_id <> 'unused'")
def window_buckets(spark, sf):
    return views.in_window(radar.weekly_counts(radar.placed(reviews(spark, sf))))


# --- brief, batch, store, stream -------------------------------------------------------------------------------------
_SLOTS = """SELECT 'total_reviews' AS slot, CAST(total_reviews AS VARCHAR) AS value FROM b UNION ALL SELECT 'n_themes', CAST(n_themes AS VARCHAR) FROM b UNION ALL SELECT 'window_days', '14'
  UNION ALL SELECT 'negative_pct', CAST(negative_pct AS VARCHAR) FROM b UNION ALL SELECT 'neutral_pct', CAST(neutral_pct AS VARCHAR) FROM b UNION ALL SELECT 'positive_pct', CAST(positive_pct AS VARCHAR) FROM b"""


def _slot_rows(key: str, source: str, fields: dict[str, str]) -> str:
    return " ".join(f"UNION ALL SELECT '{key}' || k || '.{f}', CAST({x} AS VARCHAR) FROM {source}" for f, x in fields.items())


_LABEL = f"CASE WHEN previous = 0 AND current > 0 THEN 'NEW' WHEN growth_pct IS NULL THEN 'n/a' ELSE (CASE WHEN growth_pct > 0 THEN '+' WHEN growth_pct < 0 AND growth_pct >= -0.5 THEN '-' ELSE '' END) || CAST({r('growth_pct', 0)} AS BIGINT) || '%' END"


@query(
    "brief_facts",
    f"""WITH {DECIDED}, {ROLLED}, i AS (SELECT theme_id, name, status, current, previous, {_LABEL} AS growth, {r("negative_current * factor", 2)} AS priority, {r("ratio_current", 4)} AS share FROM e),
    b AS (SELECT count(*) AS total_reviews, (SELECT count(*) FROM rolled) AS n_themes, {", ".join(r(f"100.0 * count(*) FILTER (WHERE sentiment = '{x}') / count(*)::DOUBLE", 1) + f" AS {x}_pct" for x in ("negative", "neutral", "positive"))} FROM reviews),
    rising AS (SELECT *, row_number() OVER (ORDER BY priority DESC, theme_id) AS k FROM i WHERE status IN ('NEW', 'EMERGING') QUALIFY k <= 4), falling AS (SELECT *, row_number() OVER (ORDER BY priority DESC, theme_id) AS k FROM i WHERE status = 'DECLINING' QUALIFY k <= 5),
    top AS (SELECT rolled.*, i.name, i.growth, row_number() OVER (ORDER BY negative_count DESC, rolled.theme_id) AS k FROM rolled LEFT JOIN i USING (theme_id) WHERE is_complaint QUALIFY k <= 5)
    {_SLOTS} {_slot_rows("E", "rising", {"name": "name", "current": "current", "previous": "previous", "growth": "growth", "negative_pct": r("share * 100", 1), "status": "status"})}
    {_slot_rows("C", "top", {"name": "name", "negative": "negative_count", "size": "size", "negative_pct": "negative_pct", "growth": "coalesce(growth, 'n/a')"})}
    {_slot_rows("D", "falling", {"name": "name", "growth": "growth", "current": "current", "previous": "previous"})}""",
)
def brief_facts(spark, sf):
    return spark.createDataFrame(sorted((k, str(v)) for k, v in _sheet(spark, sf)["slots"].items()), "slot string, value string")


def _sheet(spark, sf) -> dict:
    rv = reviews(spark, sf).withColumn("text_redacted", F.concat(F.lit("quote of "), "theme_id"))
    rolled = th.rollup(rv)
    return brief.facts(th.overview(rv, rolled), radar.radar(rv, themes(spark, sf)), rolled, rv)


@query("brief_template")
def brief_template(spark, sf):
    b = brief.choose(_sheet(spark, sf))
    return spark.createDataFrame([(k, str(v)) for k, v in b.items()], "part string, text string")


@query("brief_validate")
def brief_validate(spark, sf):
    good = "SUMMARY: Reviews total {total_reviews} across {n_themes} themes, of which {negative_pct} are negative.\nINVESTIGATE:\n- Check the largest theme {C1.name} first."
    bad = "SUMMARY: 500 reviews because of the crash, which definitely proves the decline of quality in general.\nINVESTIGATE:\n- Look at R99999 now please."
    return spark.createDataFrame([("good", good), ("bad", bad)], "name string, raw string").select("name", brief.validator(_sheet(spark, sf))("raw").alias("v")).select("name", "v.passed", F.array_join("v.failed", ",").alias("failed"))


@query("batch_synthetic")
def batch_synthetic(spark, sf):
    """The whole batch on the documents as reviews, dated and rated by the event of the same number, through a CSV file: its radar report. (The synthetic source itself is tested.)"""
    from tidemark.plans.batch import run_batch

    path = f"{shared_dir(spark)}/tidemark/batch-{uuid.uuid4().hex}.csv"
    dated = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), (F.col("event_id") % 5 + 1).alias("stars"))
    said = table(spark, sf, "documents").select("doc_id", F.col("text").alias("review")).join(dated, "doc_id", "left")
    said.withColumnRenamed("doc_id", "id").write.csv(path, header=True, quote='"', escape='"')
    return run_batch(spark, path)["issues"].select("theme_id", "name", "status", "current", "previous", "growth_label", "priority")


@query("store_roundtrip", f"WITH {REVIEWS} SELECT review_id, theme_id FROM reviews WHERE theme_id = 'view'")
def store_roundtrip(spark, sf):
    """A batch written and read again through the registry."""
    from tidemark.sources import store

    root = f"{shared_dir(spark)}/tidemark/batches-{uuid.uuid4().hex}"
    store.write_batch(spark, root, "b1", {"reviews": reviews(spark, sf)})
    store.register(spark, root, "b1", {"rows": 1})
    return store.read_table(spark, root, store.active(spark, root), "reviews").where("theme_id = 'view'").select("review_id", "theme_id")


@query("weekly_stream", "SELECT CAST(epoch_us(ts) // 604800000000 AS BIGINT) AS week, event_type AS theme_id, count(*) AS n FROM events GROUP BY 1, 2")
def weekly_stream(spark, sf):
    """Extension: the events replayed as a stream, all windows closed at the end."""
    from tidemark.streaming.weekly import replay

    out = replay(spark, sf)
    return out.select((F.floor(F.unix_micros("window_start") / 604_800_000_000)).cast("long").alias("week"), "theme_id", "n")
