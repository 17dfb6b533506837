"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the byte budget over its own bytes. Each document draws its number of
copies from a Poisson distribution of that mean by inverting the distribution at hash-seeded uniforms, is
exploded by that number, and all copies are shuffled by a hash of (document, copy). A rate over `PIECE` is the
sum of equal pieces with a uniform of their own each, so no probability underflows. No array is longer than about
`CHUNK` or the number of chunks: copies are exploded chunk by chunk, and where a rate passes `CHUNK`, the chunks are dealt over
tasks before their copies are made.

A draw is a function of seed and id. Rows without an id, and rows that share one, draw by their number in the input as well
(given once and stored), so that each draws for itself.

Defined results: a null source is the source ''; a null text counts as 0 bytes; sources without bytes are kept once; a
rate above `MOST` raises; an empty table gives an empty result; extra columns travel along unless named like
copy, n_copies or shuffle_key or with the prefix _mix_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Stored, partitions

PIECE = 8.0
CHUNK = 4096
MOST = 1e9
DIGITS, SPAN = 13, float(1 << 52)
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS), 16, 10).cast("double") / SPAN


def rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """(source, rate) for target weights by source (default: all alike); budget is in times the corpus."""
    own = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("own"))
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    own = own.withColumn("weight", weight)
    total = own.agg(F.sum("own").alias("bytes"), F.sum("weight").alias("weights"))
    rate = F.when(F.col("own") > 0, F.col("weight") / F.col("weights") * (F.lit(float(budget)) * F.col("bytes")) / F.col("own")).otherwise(1.0)
    return own.crossJoin(F.broadcast(total)).select("source", rate.alias("rate"))  # total has one row


def _with_cdf(rated: DataFrame) -> DataFrame:
    """(_mix_source, _mix_pieces, _mix_cdf): a piece's distribution function at 0, 1, ... until it is 1."""
    rated = rated.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)))
    lam = F.col("rate") / F.col("pieces")
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(F.exp(-lam).alias("p"), F.array(F.exp(-lam)).alias("cdf")),
        lambda a, k: F.struct((a["p"] * lam / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * lam / k)).alias("cdf")),
        lambda a: a["cdf"],
    )
    return rated.select(F.col("source").alias("_mix_source"), F.col("pieces").alias("_mix_pieces"), step.alias("_mix_cdf"))


def _chunks(n: Column) -> Column:
    """0, 1, ... one for each CHUNK of n > 0."""
    return F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / CHUNK))


def _chunk(c: Column, n: Column) -> Column:
    """The numbers from 0 to n - 1 that chunk c has."""
    return F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, n) - 1)


def _identified(docs: DataFrame) -> DataFrame:
    """docs with _mix_ident: the id, and for rows without one or that share it also their number."""
    ident = F.col("doc_id").cast("string")
    shared = Stored(docs.groupBy(F.col("doc_id").alias("_mix_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or _mix_id is null").select("_mix_id"))
    n = shared.read().count()
    if not n:
        return docs.withColumn("_mix_ident", ident)
    numbered = Stored(docs.withColumn("_mix_row", F.monotonically_increasing_id())).read()
    few = F.broadcast(shared.read()) if n <= BROADCAST_SOURCES else shared.read()
    found = numbered.join(few, F.col("doc_id").eqNullSafe(F.col("_mix_id")), "left_semi")
    rest = numbered.join(few, F.col("doc_id").eqNullSafe(F.col("_mix_id")), "left_anti")
    own = F.concat(F.coalesce(ident, F.lit("")), F.lit("#"), F.col("_mix_row").cast("string"))
    return found.withColumn("_mix_ident", own).unionByName(rest.withColumn("_mix_ident", ident)).drop("_mix_row")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: str = "mix") -> DataFrame:
    """The columns of docs, n_copies, copy (from 0) and shuffle_key; partitions are dealt by the key and sorted by it."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copy", "n_copies", "shuffle_key") and not c.lower().startswith("_mix_")])
    rated = Stored(rates(docs, weights, budget)).read()
    n, most = rated.agg(F.count(F.lit(1)), F.coalesce(F.max("rate"), F.lit(0.0))).first()
    if most > MOST:
        raise ValueError(f"a source would be repeated {most:g} times, more than {MOST:g}")
    of_source = _with_cdf(rated)
    out = _identified(docs).join(F.broadcast(of_source) if n <= BROADCAST_SOURCES else of_source, F.coalesce("source", F.lit("")) == F.col("_mix_source"))
    ident, cdf, pieces = F.col("_mix_ident"), F.col("_mix_cdf"), F.col("_mix_pieces")
    draw = lambda j: F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), ident, (j + 1).cast("string")))).cast("long")
    total = lambda numbers, own: F.aggregate(numbers, F.lit(0).cast("long"), lambda a, j: a + own(j))
    out = out.withColumn("_mix_n", total(_chunks(pieces), lambda c: total(_chunk(c, pieces), draw))).where("_mix_n > 0")
    out = out.withColumn("_mix_chunk", F.explode(_chunks(F.col("_mix_n")))).drop("_mix_source", "_mix_pieces", "_mix_cdf")
    if most > CHUNK:
        out = out.repartition(partitions(docs), "_mix_ident", "_mix_chunk")
    out = out.withColumn("copy", F.explode(_chunk(F.col("_mix_chunk"), F.col("_mix_n"))))
    out = out.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long"))
    out = out.withColumns({"n_copies": F.col("_mix_n").cast("int"), "copy": F.col("copy").cast("int")}).drop("_mix_ident", "_mix_chunk", "_mix_n")
    return out.repartition(partitions(docs), "shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "text", "copy", "n_copies", "shuffle_key")


_U = "CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
QUERIES = {"op3_mix": op3_mix}
ORACLES = {
    "op3_mix": f"""
WITH RECURSIVE own AS (SELECT coalesce(source, '') AS src, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS own FROM documents GROUP BY 1),
r AS (SELECT src, CASE WHEN own > 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM own)::DOUBLE * (1.0::DOUBLE * (SELECT sum(own) FROM own)::DOUBLE) / own::DOUBLE ELSE 1.0 END AS rate FROM own),
p AS (SELECT src, rate, CAST(greatest(ceil(rate / 8.0), 1) AS INTEGER) AS pieces FROM r),
c AS (SELECT src, pieces, rate / pieces AS lam, 0 AS k, exp(-(rate / pieces)) AS p, exp(-(rate / pieces)) AS cdf FROM p
  UNION ALL SELECT src, pieces, lam, k + 1, p * lam / (k + 1), cdf + p * lam / (k + 1) FROM c WHERE k < 60),
l AS (SELECT src, any_value(pieces) AS pieces, list(cdf ORDER BY k) AS cdf FROM c GROUP BY src),
n AS (SELECT d.doc_id, d.source, d.text, CAST(sum(len(list_filter(l.cdf, lambda x: x <= {_U}))) AS INTEGER) AS n_copies
  FROM documents d JOIN l ON coalesce(d.source, '') = l.src, unnest(generate_series(1, l.pieces)) AS g(j) GROUP BY ALL)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, n_copies,
  CAST('0x' || substr(md5('mix:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key
FROM n, unnest(generate_series(0, n_copies - 1)) AS u(copy) WHERE n_copies > 0"""
}
