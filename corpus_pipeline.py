"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns that they were given, under the
same names and with the same values: columns besides those of documents travel packed in one, so that no operator's own column can clash with them. The last
adds its columns, and leaves out given ones of their names. run() writes each stage's rows to the shared folder and reads them again for the next.

Defined results, for every stage: a null or empty text is a document without words (clean, linked with nothing, without leaks, 0 bytes); null ids are documents of their
own; repeated rows are judged each, but near-duplicate detection keeps one of them; of equal candidates the least id stays; a text of any length is read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import containment, jaccard, mixing, shards, toxicity
from tidemark.llm.common import Stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PACKED = "_pipeline_packed"
SHARDS = 24
BROADCAST_IDS = 1_000_000


def keeping(stage):
    """A stage whose operators see the columns of documents only; others are packed and come back as they were."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c.lower() not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        own = [F.col(f"`{c}`") for c in docs.columns if c not in others]
        out = stage(spark, docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in others]).alias(PACKED)), sf_dir)
        return out.select(*[F.col(PACKED).getField(c).alias(c) if c in others else F.col(f"`{c}`") for c in docs.columns])

    return run_stage


@keeping
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; a score of exactly 0.5 is toxic."""
    model = toxicity.fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.5").drop("score")


@keeping
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked rows, the one with the least id (null last), the first of such rows; texts without words stay."""
    rows = jaccard.numbered(docs)
    others = Stored(jaccard.linked(rows).where("not kept").select("rowno")).read()
    return rows.join(F.broadcast(others) if others.count() <= BROADCAST_IDS else others, "rowno", "left_anti").select(docs.columns)


@keeping
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return containment.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@keeping
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source brought to an equal share of the bytes by Poisson replication."""
    return mixing.mix(docs).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return shards.shuffle_into_shards(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = Stored(stage(spark, docs, sf_dir)).read()
    return STAGES[-1][1](spark, docs, sf_dir)
