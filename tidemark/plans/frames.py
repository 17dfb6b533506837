"""The given tables seen as the engine's own: events and documents as reviews, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import small_batches, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents, their rows spread over all cores: files may come in fewer pieces than there are cores. Python gets them in small batches."""
    small_batches(spark)
    return spread(table(spark, sf_dir, "documents").select(*columns))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated, scored reviews: theme by type, sentiment by bands of the value, segments by the property."""
    k = F.get_json_object("props", "$.k").cast("int")
    a, b, c = F.col("event_id") % 7 + 1, F.col("user_id") % 5 + 1, F.col("event_id") % 11 + 1
    total = (a + b + c).cast("double")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("R"), F.col("event_id").cast("string")).alias("review_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("theme_id"),
        F.when(F.col("value") < 40, "negative").when(F.col("value") < 70, "neutral").otherwise("positive").alias("sentiment"),
        ((F.col("event_id") % 500 + 500) / 1000.0).alias("confidence"),
        ((F.col("event_id") % 1000) / 1000.0).alias("similarity"),
        F.concat(F.lit("k"), (k % 3).cast("string")).alias("platform"),
        F.concat(F.lit("5."), (k % 4).cast("string")).alias("app_version"),
        (F.col("event_id") % 6).cast("int").alias("rating"),
        F.when(F.col("user_id") % 2 == 0, "negative").otherwise("positive").alias("truth"),
        (a / total).alias("p_negative"),
        (b / total).alias("p_neutral"),
        (c / total).alias("p_positive"),
    )


REVIEWS = """reviews AS (SELECT 'R' || event_id AS review_id, ts AS created_at, event_type AS theme_id,
  CASE WHEN value < 40 THEN 'negative' WHEN value < 70 THEN 'neutral' ELSE 'positive' END AS sentiment,
  (event_id % 500 + 500) / 1000.0::DOUBLE AS confidence, (event_id % 1000) / 1000.0::DOUBLE AS similarity,
  'k' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 3) AS platform, '5.' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) AS app_version,
  CAST(event_id % 6 AS INTEGER) AS rating, CASE WHEN user_id % 2 = 0 THEN 'negative' ELSE 'positive' END AS truth,
  (event_id % 7 + 1) / (event_id % 7 + 1 + user_id % 5 + 1 + event_id % 11 + 1)::DOUBLE AS p_negative,
  (user_id % 5 + 1) / (event_id % 7 + 1 + user_id % 5 + 1 + event_id % 11 + 1)::DOUBLE AS p_neutral,
  (event_id % 11 + 1) / (event_id % 7 + 1 + user_id % 5 + 1 + event_id % 11 + 1)::DOUBLE AS p_positive FROM events)"""


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spine: every event type, and one theme without reviews."""
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("theme_id")).distinct()
    return own.union(spark.createDataFrame([("unused",)], "theme_id string")).withColumn("name", F.initcap("theme_id"))


THEMES = """themes AS (SELECT theme_id, upper(theme_id[1]) || lower(theme_id[2:]) AS name
  FROM (SELECT DISTINCT event_type AS theme_id FROM events UNION ALL SELECT 'unused'))"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as review texts; the source is the theme."""
    return texts(spark, sf_dir, "doc_id", "text", "source", "lang").select(
        F.col("doc_id").alias("_pos"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("review_id"), "text", F.col("source").alias("theme_id"), F.col("lang").alias("platform"),
        F.lit(None).cast("string").alias("app_version"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") % 10).cast("int"))).alias("created_at"),
    )


DOCS = """docs AS (SELECT doc_id AS _pos, 'D' || doc_id AS review_id, text, source AS theme_id, lang AS platform, NULL::VARCHAR AS app_version,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id % 10 AS INTEGER)) AS created_at FROM documents)"""
