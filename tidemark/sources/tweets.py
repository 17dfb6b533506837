"""Header-less labelled text files, and training corpora with star ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.sources.lines import fields, numbered_lines, read_table

COLUMNS = ("target", "id", "date", "flag", "user", "text")


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """(line, fields, target, id, date, flag, user, text) of latin-1 CSV files: line numbers run through all files by name, and malformed lines keep their number of fields. Blank lines
    are numbered and left out."""
    lines = numbered_lines(spark, path, "ISO-8859-1").where(F.trim("value") != "")
    f = fields(F.col("value"), (*COLUMNS, "extra"))
    n = sum(F.col(f"_f.{c}").isNotNull().cast("int") for c in (*COLUMNS, "extra"))
    return lines.select("line", f.alias("_f")).select("line", n.alias("fields"), *[F.col(f"_f.{c}").alias(c) for c in COLUMNS])


def read_rated(spark: SparkSession, path: str, text: str = "Review", rating: str = "Rating") -> tuple[DataFrame, DataFrame]:
    """(kept, counts): rows with a text and a rating of 1 to 5, labelled by stars and dated by hash; counts has rows and skipped."""
    raw = read_table(spark, path)
    out = raw.select("_pos", parse.squeezed_ends(F.coalesce(F.col(text), F.lit(""))).alias("text"), parse.rating(F.coalesce(F.col(rating), F.lit(""))).alias("rating"))
    ok = (F.col("text") != "") & F.col("rating").between(1, 5)
    kept = out.where(ok).select(F.format_string("AC%06d", "_pos").alias("review_id"), "text", "rating", parse.stars(F.col("rating")).alias("gt_sentiment"), parse.hashed_date(F.col("text")).alias("created_at"))
    return kept, out.agg(F.count_if(ok).alias("rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("skipped"))


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """val, test and train files of a folder, with their split."""
    one = lambda name: read_table(spark, f"{folder}/{name}.csv", position="_row").drop("_row").withColumn("split", F.lit(name))
    return one("train").unionByName(one("val"), allowMissingColumns=True).unionByName(one("test"), allowMissingColumns=True)
