"""Themes over sentence vectors: density clusters, merging, centroids, assignment, keywords, names, representatives.

Vectors are array<float> keyed by id; membership is a column. Only per-theme values (k of them) ever reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.numbers import rounded
from tidemark.operators.embedding import embed  # noqa: F401
from tidemark.operators.density import Cells, density_labels, labels_by_size, min_cluster_size, min_samples, tree_edges, tree_labels
from tidemark.operators.linkage import Linkage, average_linkage
from tidemark.shared import Stored


@dataclass(frozen=True)
class Params:
    # Sizes and thresholds of discovery.
    pca_components: int = 20
    merge_threshold: float = 0.65
    assign_threshold: float = 0.60
    n_keywords: int = 8
    n_representatives: int = 5
    exact_density_most: int = 5000
    cells: Cells = Cells()
    linkage: Linkage = Linkage()
    broadcast_clusters: int = 1_000_000
    seed: int = 42


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / (norm(a) + 1e-12))


def reduced(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Adds reduced: centred principal components."""
    out = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    out = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(out).transform(out)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(out)
    return model.transform(out).withColumn("reduced", vector_to_array("_p")).drop("_v", "_c", "_p")


def micro_clusters(df: DataFrame, vector: str = "embedding", key: str = "vec_id", p: Params = Params()) -> DataFrame:
    """(key, micro): density clusters on principal components, -1 noise; exact at every size. A label is a number from 0 in the order of the clusters' least keys.

    Up to `exact_density_most` rows the driver finds them; beyond, tasks do over cells of rows, with the same labels.
    """
    n = df.count()
    if n == 0:
        return df.select(key).withColumn("micro", F.lit(-1))
    dims = len(df.select(vector).first()[0])
    low = reduced(df, vector, min(p.pca_components, dims, max(2, n - 1)))
    size, samples = min_cluster_size(n), min_samples(n)
    if n <= p.exact_density_most:
        rows = low.select(key, "reduced").orderBy(key).collect()  # at most exact_density_most rows
        labels = density_labels(np.array([r["reduced"] for r in rows]), size, samples)
        micro = np.unique(labels[labels >= 0], return_inverse=True)[1]
        labels[labels >= 0] = micro
        return df.sparkSession.createDataFrame([(r[key], int(c)) for r, c in zip(rows, labels)], f"{key} long, micro int")
    points = Stored(low.select(F.col(key).cast("long").alias("id"), "reduced")).read()
    found = Stored(tree_labels(points.select("id"), tree_edges(points, n, samples, p.cells), size, p.cells.top)).read()
    numbered = found.where("micro is not null").select("micro").distinct().withColumn("number", F.row_number().over(Window.orderBy("micro")) - 1)  # one row a cluster
    return found.join(numbered, "micro", "left").select(F.col("id").alias(key), F.coalesce("number", F.lit(-1)).cast("int").alias("micro"))


def merge_micro(df: DataFrame, micro: str = "micro", vector: str = "embedding", p: Params = Params()) -> DataFrame:
    """df with theme_rank instead of micro: average linkage of centroids by cosine, ranked by size; null is noise."""
    cents = centroids(df.where(F.col(micro) >= 0), micro, vector)
    groups = average_linkage(cents.select(F.col(micro).cast("long").alias("id"), F.col("centroid").alias("v")), p.merge_threshold, p.linkage)  # one row a cluster
    sizes = df.groupBy(F.col(micro).cast("long").alias("id")).agg(F.count("*").alias("own")).join(groups, "id").groupBy("into").agg(F.sum("own").alias("n"))
    ranks = sizes.select("into", F.row_number().over(Window.orderBy(F.desc("n"), "into")).alias("theme_rank"))  # one row a theme
    of = Stored(groups.join(ranks, "into").select(F.col("id").alias("_micro"), "theme_rank")).read()
    few = F.broadcast(of) if of.count() <= p.broadcast_clusters else of
    return df.join(few, F.col(micro) == F.col("_micro"), "left").drop("_micro", micro)


def centroids(df: DataFrame, theme: str, vector: str) -> DataFrame:
    """(theme, centroid): the unit mean of each theme's vectors."""
    dims = F.posexplode(vector).alias("d", "x")
    mean = df.select(theme, dims).groupBy(theme, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy(theme).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"))
    return whole.select(theme, F.transform("c", lambda x: x / (norm(F.col("c")) + 1e-12)).alias("centroid"))


def coherence(df: DataFrame, theme: str, vector: str, cents: DataFrame) -> DataFrame:
    """(theme, size, coherence): mean similarity of members to their theme's centroid."""
    return df.join(F.broadcast(cents), theme).groupBy(theme).agg(F.count("*").alias("size"), rounded(F.avg(dot(F.col(vector), F.col("centroid"))), 4).alias("coherence"))


def nearest(df: DataFrame, vector: str, cents: DataFrame, theme: str, threshold: float = 0.60) -> DataFrame:
    """Adds near_theme and near_similarity: the likeliest centroid, null below the threshold. Centroids are one a theme."""
    packed = cents.agg(F.collect_list(F.struct(theme, "centroid")).alias("_all"))
    out = df.crossJoin(F.broadcast(packed))  # one row
    best = F.array_max(F.transform("_all", lambda c: F.struct(dot(F.col(vector), c["centroid"]).alias("s"), (-c[theme]).alias("t"))))
    out = out.withColumn("_b", best).withColumn("near_similarity", F.col("_b.s"))
    return out.withColumn("near_theme", F.when(F.col("near_similarity") >= threshold, -F.col("_b.t"))).drop("_b", "_all")


def assigned(df: DataFrame, vector: str = "embedding", p: Params = Params()) -> DataFrame:
    """From theme_rank (null: noise): theme_rank, theme_id, theme_assignment and theme_similarity."""
    cents = centroids(df.where("theme_rank is not null"), "theme_rank", vector)
    out = nearest(df, vector, cents, "theme_rank", p.assign_threshold)
    own = out.join(F.broadcast(cents), "theme_rank", "left").withColumn("own", dot(F.col(vector), F.col("centroid")))
    kind = F.when(F.col("theme_rank").isNotNull(), "cluster").when(F.col("near_theme").isNotNull(), "nearest_centroid").otherwise("unassigned")
    rank = F.coalesce("theme_rank", "near_theme").cast("int")
    own = own.withColumn("theme_assignment", kind).withColumn("theme_similarity", F.coalesce("own", F.when(F.col("near_theme").isNotNull(), F.col("near_similarity")), F.lit(0.0)))
    return own.withColumn("theme_rank", rank).withColumn("theme_id", F.when(rank.isNotNull(), F.format_string("theme_%03d", rank))).drop("centroid", "own", "near_theme", "near_similarity")


def representatives(df: DataFrame, theme: str, key: str, text: str, similarity: str, k: int = 5) -> DataFrame:
    """(theme, key, rank): members by similarity, one for each distinct lower-case text."""
    each = Window.partitionBy(theme, F.lower(text)).orderBy(F.desc(similarity), key)
    best = df.where(F.col(theme).isNotNull()).withColumn("_r", F.row_number().over(each)).where("_r = 1")
    order = Window.partitionBy(theme).orderBy(F.desc(similarity), key)
    return best.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select(theme, key, "rank")


def grams(words: DataFrame, theme: str, kept: list[str] | None = None) -> DataFrame:
    """(theme, term): pairs of neighbours in each row's w; with `kept` only pairs of such words."""
    if kept is not None:
        words = words.select(theme, F.transform("w", lambda x: F.when(x.isin(*kept), x)).alias("w"))
    pairs = F.transform("w", lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))  # null at the end and beside words not kept
    return words.select(theme, F.explode_outer(pairs).alias("term")).where("term is not null")


def ctfidf(df: DataFrame, theme: str, text: str, stop: list[str], k: int = 24, most: int = 10_000) -> DataFrame:
    """(theme, term, score) of one- and two-word terms, stop words removed first: term share in the theme times ln(1 + mean terms per theme /
    term frequency). All terms that can be among the k highest of a theme are there, also after rounding to 9 places, and each score is exact.

    Words are counted first. A pair occurs no more often than either of its words, and a term with n occurrences in a theme scores no more than
    if it had them there alone, which rises with n. So pairs with a word that stays below the k-th word's score in every theme need no count, and
    where at most `most` words are left (else all pairs are counted) only pairs of these are counted, in all themes."""
    words = df.where(F.col(theme).isNotNull()).select(theme, tx.tokens(F.col(text), stop).alias("w"))
    found = words.select(theme, F.posexplode_outer("w").alias("at", "term")).where("term is not null")  # inner ones find the words twice: once to drop empty rows
    each = found.groupBy(theme, "term").agg(F.count("*").alias("tf"), F.count_if(F.col("at") == 0).alias("first"))
    ones = Stored(each).read()
    per_theme = ones.groupBy(theme).agg((2 * F.sum("tf") - F.sum("first")).alias("words"))  # a text of n words has n - 1 pairs
    average = per_theme.agg(F.avg("words").alias("avg_words"))
    freq = F.sum("tf").over(Window.partitionBy("term"))  # a row for each theme that has the term
    sized = lambda tf: tf.withColumn("freq", freq).join(F.broadcast(per_theme), theme).crossJoin(F.broadcast(average))  # noqa: E731  one row a theme, one row
    value = lambda n: F.col("tf") / F.col("words") * F.ln(1 + F.col("avg_words") / F.col(n))
    scored = Stored(sized(ones.select(theme, "term", "tf")).select(theme, "term", value("freq").alias("score"), value("tf").alias("bound"))).read()
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy(theme).orderBy(F.desc("score")))).where(F.col("r") == k).select(theme, F.col("score").alias("least"))
    able = scored.join(F.broadcast(best), theme, "left").where(F.col("bound") * (1 + 1e-9) >= F.coalesce("least", F.lit(0.0)) - 2e-9)  # room for rounding
    kept = [r["term"] for r in able.select("term").distinct().limit(most + 1).collect()]
    pairs = grams(words, theme, kept if len(kept) <= most else None).groupBy(theme, "term").agg(F.count("*").alias("tf"))
    return scored.select(theme, "term", "score").unionByName(sized(pairs).select(theme, "term", value("freq").alias("score")))


def keywords(scores: DataFrame, theme: str, k: int = 8) -> DataFrame:
    """(theme, keywords, scores): top terms; once two are chosen, a term is passed over that shares words with a chosen two-word one."""
    w = Window.partitionBy(theme).orderBy(F.desc("score"), "term")
    top = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 3 * k)
    listed = top.groupBy(theme).agg(F.sort_array(F.collect_list(F.struct("r", "term", "score"))).alias("t"))
    two = lambda x: F.instr(x, " ") > 0
    inside = lambda a, b: F.array_contains(F.split(b, " "), a)
    pick = F.aggregate(
        "t",
        F.array().cast("array<struct<r:int,term:string,score:double>>"),
        lambda acc, x: F.when(
            (F.size(acc) >= k) | ((F.size(acc) >= 2) & F.exists(acc, lambda c: (two(c["term"]) | two(x["term"])) & (inside(x["term"], c["term"]) | inside(c["term"], x["term"])))), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    out = listed.withColumn("p", pick)
    return out.select(theme, F.transform("p", lambda x: x["term"]).alias("keywords"), F.transform("p", lambda x: x["score"]).alias("scores"))


def coverage(df: DataFrame, theme: str, key: str, text: str, stop: list[str]) -> DataFrame:
    """(theme, stem, cov, score, r): document share of each stem in its theme times the log of its lift, from a share of 10 %. Texts are
    read once; rows without a theme count for the lift only."""
    words = df.select(key, theme, F.explode(F.array_distinct(F.transform(tx.tokens(F.col(text), stop), tx.stem))).alias("stem"))
    here = words.groupBy(theme, "stem").agg(F.count("*").alias("df_c"))
    sizes = Stored(df.groupBy(theme).agg(F.count("*").alias("size"))).read()
    n = sizes.agg(F.sum("size").alias("n"))
    out = here.withColumn("df_all", F.sum("df_c").over(Window.partitionBy("stem")))  # a row for each theme that has the stem
    out = out.join(sizes, theme).crossJoin(F.broadcast(n))  # one row
    cov, cov_all = F.col("df_c") / F.col("size"), F.col("df_all") / F.col("n")
    out = out.withColumns({"cov": cov, "score": cov * F.ln(cov / cov_all)}).where(F.col("cov") >= 0.10)
    w = Window.partitionBy(theme).orderBy(F.desc("score"), F.desc("cov"), F.desc("stem"))
    return out.select(theme, "stem", "cov", "score", F.row_number().over(w).alias("r"))


def surfaces(df: DataFrame, text: str, stop: list[str]) -> DataFrame:
    """(stem, surface): the most frequent word of each stem, the least on a tie."""
    words = df.select(F.explode(tx.tokens(F.col(text), stop)).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n")).withColumn("stem", tx.stem(F.col("w")))
    return counts.groupBy("stem").agg(F.min_by("w", F.struct(-F.col("n"), F.col("w"))).alias("surface"))


def names(df: DataFrame, theme: str, key: str, text: str, stop: list[str]) -> DataFrame:
    """(theme, name): the best one or two stems of each theme in their usual form."""
    cov = coverage(df, theme, key, text, stop).where("r <= 2").join(surfaces(df, text, stop), "stem")
    both = cov.groupBy(theme).agg(F.sort_array(F.collect_list(F.struct("r", "surface", "score"))).alias("t"))
    second = (F.size("t") > 1) & (F.try_element_at("t", F.lit(2))["score"] >= 0.35 * F.col("t")[0]["score"])
    named = F.when(second, F.concat(F.col("t")[0]["surface"], F.lit(" "), F.try_element_at("t", F.lit(2))["surface"])).otherwise(F.col("t")[0]["surface"])
    every = df.where(F.col(theme).isNotNull()).select(theme).distinct()
    return every.join(both, theme, "left").select(theme, F.coalesce(tx.title(named), F.lit("Unnamed Theme")).alias("name"))


def fallback_name(keywords_col: Column, scores: Column) -> Column:
    """The first two-word keyword if it scores half of the top one, else the first two single words."""
    pairs = F.filter(F.arrays_zip(keywords_col.alias("k"), scores.alias("s")), lambda x: F.instr(x["k"], " ") > 0)
    singles = F.filter(keywords_col, lambda x: F.instr(x, " ") == 0)
    first = F.try_element_at(pairs, F.lit(1))
    pair = F.when(first["s"] >= 0.5 * F.try_element_at(scores, F.lit(1)), tx.title(first["k"]))
    two = F.when(F.size(singles) > 0, tx.title(F.array_join(F.slice(singles, 1, 2), " ")))
    return F.when(F.size(keywords_col) <= 0, "Unnamed Theme").otherwise(F.coalesce(pair, two, tx.title(F.try_element_at(keywords_col, F.lit(1)))))


def unique_names(rows: list[tuple[int, str, list[str]]]) -> list[tuple[int, str]]:
    """Names made unique in theme order by the first keyword that isn't part of the name yet; for the k themes on the driver."""
    used, out = set(), []
    for rank, name, words in rows:
        if name in used:
            extra = next((w for w in words if w.title() not in name), str(rank - 1))
            name = f"{name} / {extra.title()}"
        used.add(name)
        out.append((rank, name))
    return out


def grid(df: DataFrame, truth: str, sizes: tuple[int, ...], samples: tuple[int, ...], vector: str = "embedding", key: str = "vec_id", p: Params = Params()) -> DataFrame:
    """(samples, size, n_clusters, noise, ari): density clusters of every setting held against `truth`, with noise as one cluster.

    Vectors are reduced once; each number of samples has one spanning tree, condensed at all sizes without another search.
    """
    n = df.count()
    dims = len(df.select(vector).first()[0])
    low = reduced(df, vector, min(p.pca_components, dims, max(2, n - 1)))
    points = Stored(low.select(F.col(key).cast("long").alias("id"), "reduced", F.col(truth).alias("truth"))).read()
    found = None
    for many in samples:
        edges = tree_edges(points.select("id", "reduced"), n, many, p.cells)
        own = labels_by_size(points.select("id"), edges, sizes, p.cells.top).withColumn("samples", F.lit(many))
        found = own if found is None else found.unionByName(own)
    settings = ["samples", "size"]
    rows = found.join(points.select("id", "truth"), "id").withColumn("cluster", F.coalesce("micro", F.lit(-1)))
    cells = rows.groupBy(*settings, "truth", "cluster").agg(F.count("*").cast("double").alias("n"))
    cells = Stored(cells).read()
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    by = lambda c: cells.groupBy(*settings, c).agg(F.sum("n").alias("m"))
    a = by("truth").groupBy(*settings).agg(pairs(F.col("m")).alias("pa"), F.sum("m").alias("all"))
    b = by("cluster").groupBy(*settings).agg(pairs(F.col("m")).alias("pb"), F.count_if(F.col("cluster") >= 0).alias("n_clusters"), F.coalesce(F.sum(F.when(F.col("cluster") < 0, F.col("m"))), F.lit(0.0)).cast("long").alias("noise"))
    out = cells.groupBy(*settings).agg(pairs(F.col("n")).alias("idx")).join(a, settings).join(b, settings)
    expected, mean = F.col("pa") * F.col("pb") / (F.col("all") * (F.col("all") - 1) / 2), (F.col("pa") + F.col("pb")) / 2
    return out.select(*settings, "n_clusters", "noise", rounded(F.when(mean == expected, 1.0).otherwise((F.col("idx") - expected) / (mean - expected)), 4).alias("ari"))


def discover(df: DataFrame, key: str, text: str, vector: str = "embedding", p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(rows with theme columns, themes): the whole of discovery over (key, text, vector)."""
    micro = micro_clusters(df, vector, key, p)
    rows = Stored(assigned(merge_micro(df.join(micro, key), "micro", vector, p), vector, p)).read()  # many passes read them
    stop = tx.stop_words()
    kw = keywords(ctfidf(rows, "theme_rank", text, stop), "theme_rank", p.n_keywords)
    cover = names(rows, "theme_rank", key, text, stop)
    base = cover.join(kw, "theme_rank", "left").withColumn("name", F.when((F.col("name") == "Unnamed Theme") & F.col("keywords").isNotNull(), fallback_name(F.col("keywords"), F.col("scores"))).otherwise(F.col("name")))
    listed = base.select("theme_rank", "name", "keywords").orderBy("theme_rank").collect()  # one row a theme
    unique = df.sparkSession.createDataFrame(unique_names([(r[0], r[1], r[2] or []) for r in listed]), "theme_rank int, name string")
    sizes = rows.where("theme_rank is not null").groupBy("theme_rank", "theme_id").agg(
        F.count("*").alias("size"), F.count_if(F.col("theme_assignment") == "cluster").alias("core_size"), rounded(F.avg("theme_similarity"), 4).alias("coherence")
    )
    reps = representatives(rows, "theme_rank", key, text, "theme_similarity", p.n_representatives).groupBy("theme_rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("representative_ids"))
    themes = sizes.join(unique, "theme_rank").join(base.select("theme_rank", "keywords"), "theme_rank").join(reps, "theme_rank", "left")
    return rows, themes


def rollup(reviews: DataFrame) -> DataFrame:
    """Per theme: size, sentiment counts, negative_pct, complaint flag and average rating (0 and null left out)."""
    neg = F.count_if(F.col("sentiment") == "negative")
    return reviews.where("theme_id is not null").groupBy("theme_id").agg(
        F.count("*").alias("size"),
        neg.alias("negative_count"),
        F.count_if(F.col("sentiment") == "neutral").alias("neutral_count"),
        F.count_if(F.col("sentiment") == "positive").alias("positive_count"),
        rounded(100.0 * neg / F.count("*"), 1).alias("negative_pct"),
        (neg / F.count("*") >= 0.5).alias("is_complaint"),
        rounded(F.avg(F.when(F.col("rating") != 0, F.col("rating"))), 2).alias("avg_rating"),
    )


def overview(reviews: DataFrame, rolled: DataFrame) -> DataFrame:
    """One row of batch figures; pii_redactions_total only where rows are counted for it."""
    s = F.col("sentiment")
    pct = lambda x: rounded(100.0 * F.count_if(s == x) / F.count("*"), 1).alias(f"{x}_pct")
    base = reviews.agg(
        F.count("*").alias("total_reviews"), *[F.count_if(s == x).alias(f"{x}_count") for x in ("negative", "neutral", "positive")], *[pct(x) for x in ("negative", "neutral", "positive")],
        rounded(F.avg(F.when(F.col("rating") != 0, F.col("rating"))), 2).alias("avg_rating"), F.min("created_at").alias("first_ts"), F.max("created_at").alias("last_ts"),
    )
    if "pii_redaction_count" in reviews.columns:
        base = base.crossJoin(reviews.agg(F.coalesce(F.sum("pii_redaction_count"), F.lit(0)).alias("pii_redactions_total")))  # one row
    worst = F.min_by(F.when(F.col("is_complaint"), F.col("theme_id")), F.when(F.col("is_complaint"), F.struct(-F.col("negative_count"), F.col("theme_id"))))
    themes = rolled.agg(F.count("*").alias("n_themes"), F.count_if("is_complaint").alias("n_complaint_themes"), worst.alias("top_complaint"))
    return base.crossJoin(themes)  # one row each


def emerging(issues: DataFrame) -> DataFrame:
    """The new and emerging issues of an overview, by priority."""
    return issues.where(F.col("status").isin("NEW", "EMERGING")).select("theme_id", "name", "status", "current", "previous", "growth_pct", "growth_label", "negative_ratio", "priority").orderBy(F.desc("priority"), "theme_id")


