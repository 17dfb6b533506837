"""URL filtering: declared host and path rules, else association rules mined by Spark's FP-growth.

A url's items are its host labels, path segments (numbers as '#'), query keys and scheme. FP-growth mines
the labelled urls' items together with a label item; rules `items -> bad` that reach the confidence, the
support and the lift over the base rate are kept, and a rule is dropped when a shorter one says the same.
The rules are indexed by the one of their items that the fewest labelled urls have, so that a url is held against few of
them, and a url is blocked when a rule's items are all its own. A rule needs `least` labelled urls whatever the support is.

Defined results: a null url, or one without '://', has an empty host and path and is judged by no declared
rule; a repeated url is judged once and every row gets the verdict; no labels, or no rule that survives, give
'allow'; empty tables give empty results or 'allow'. Extra columns travel along in `judge` unless named like one that it adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Stored

# The declared rules (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    support: float = 0.002
    least: int = 5
    confidence: float = 0.6
    lift: float = 1.5
    broadcast_rules: int = 20_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def declared(host: Column, path: Column) -> Column:
    """struct<rule, verdict> of the longest declared rule that fits; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def items(url: Column) -> Column:
    """The distinct tokens of a url, as sorted array<string>."""
    u = F.coalesce(url, F.lit(""))
    labels = F.transform(F.split(host_of(u), r"\."), lambda x: F.concat(F.lit("host="), x))
    steps = F.transform(F.split(path_of(u), r"[/.\-_]"), lambda x: F.concat(F.lit("path="), F.regexp_replace(F.lower(x), r"[0-9]+", "#")))
    keys = F.transform(F.regexp_extract_all(u, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key="), F.lower(x)))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(labels, steps, keys, scheme), lambda x: ~x.endswith("="))))


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Rules (items, confidence, support, probe) from a table of (url, bad boolean); probe: the rule's item that is rarest there."""
    known = labelled.where(F.col("bad").isNotNull()).select(items(F.col("url")).alias("items"), "bad")
    n = known.count()
    if n < mining.least:
        return labelled.sparkSession.createDataFrame([], "items array<string>, confidence double, support double, probe string")
    tx = known.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(mining.support, mining.least / n)), minConfidence=mining.confidence).fit(tx)
    found = model.associationRules.where(F.col("consequent")[0] == BAD).where(F.col("lift") >= mining.lift)
    rules = Stored(found.select(F.array_sort("antecedent").alias("items"), "confidence", "support")).read()
    shorter = rules.select(F.col("items").alias("s"), F.col("confidence").alias("sc"), F.explode("items").alias("k"))
    longer = rules.select("items", "confidence", F.explode("items").alias("k"))
    redundant = longer.join(shorter, "k").where((F.size("s") < F.size("items")) & (F.size(F.array_except("s", "items")) == 0) & (F.col("sc") >= F.col("confidence"))).select("items").distinct()
    kept = rules.join(redundant, "items", "left_anti")
    rare = kept.select("items", F.explode("items").alias("k")).join(known.select(F.explode("items").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")
    return Stored(kept.join(rare.groupBy("items").agg(F.min(F.struct("n", "k"))["k"].alias("probe")), "items")).read()


def matched(pages: DataFrame, rules: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(url, confidence) of the urls that a mined rule fires on, through the rules' inverted index."""
    index = rules.select(F.col("probe").alias("k"), F.col("items").alias("need"), "confidence")
    n = index.count()
    if n == 0:
        return pages.sparkSession.createDataFrame([], "url string, confidence double")
    own = pages.select("url").where(F.col("url").isNotNull()).distinct().withColumn("have", items(F.col("url")))
    probes = own.select("url", "have", F.explode("have").alias("k"))
    hits = probes.join(F.broadcast(index) if n <= mining.broadcast_rules else index, "k").where(F.size(F.array_except("need", "have")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


ADDED = ("host", "path", "rule", "verdict", "confidence", "_d")


def judge(pages: DataFrame, labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Adds host, path, rule, verdict and the mined confidence (null: none fired) to every page."""
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in ADDED])
    fired = matched(pages, mine(labelled.select("url", "bad"), mining), mining)
    out = pages.join(fired, "url", "left").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumn("_d", declared(F.col("host"), F.col("path")))
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.withColumns({"rule": F.col("_d.rule"), "verdict": F.coalesce(F.col("_d.verdict"), method)}).drop("_d")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts as bad for the miner when the label row of its number says low quality."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(pages, pages.join(labels, "page_id")).select("page_id", "host", "path", "rule", "verdict", "confidence")


QUERIES = {"op5_url_rules": op5_url_rules}
ORACLES: dict = {}
