"""Profiles, conflicts, splits and seeded samples of labelled text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.functions.numbers import rounded
from tidemark.shared import Stored


def text_profile(df: DataFrame, text: str) -> DataFrame:
    """One row: lengths, empties, duplicates and pattern counts of a text column, in one aggregation."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(parse.squeezed_ends(t))
    key = F.lower(parse.squeezed_ends(t))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(n == 0).alias("empty_text"),
        (F.count("*") - F.countDistinct(F.md5(key))).alias("duplicate_texts"),  # digests, so that no text is shuffled
        F.min(n).cast("long").alias("min_length"),
        F.max(n).cast("long").alias("max_length"),
        rounded(F.avg(n), 2).alias("mean_length"),
        F.percentile(n, 0.5).alias("median_length"),
        rounded(F.percentile(n, 0.95), 4).alias("p95_length"),
        F.count_if(t.contains("�")).alias("replacement_char_rows"),
        F.count_if(t.contains("&quot;") | t.contains("&amp;") | t.contains("&lt;") | t.contains("&gt;")).alias("html_entity_rows"),
        F.count_if(t.contains("http://") | t.contains("https://") | t.contains("www.")).alias("url_rows"),
        F.count_if(t.contains("@")).alias("mention_rows"),
    )


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing): null or blank values."""
    one = df.agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def months(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def tweets(df: DataFrame) -> DataFrame:
    """One row for a labelled tweet file (source_line, fields, target, id, date, flag, user, text)."""
    ok = F.col("fields") == 6
    ts = parse.tweet_date(F.col("date"))
    base = df.agg(F.count("*").alias("rows"), F.count_if(ok).alias("well_formed_rows"), F.count_if(~ok).alias("malformed_rows"), F.countDistinct(F.when(ok, F.col("user"))).alias("unique_users"), F.count_if(ok & ts.isNull()).alias("unparseable_dates"), F.min(F.when(ok, ts)).alias("date_min"), F.max(F.when(ok, ts)).alias("date_max"), F.count_if(ok & ~F.col("target").isin("0", "4")).alias("unexpected_labels"))
    ids = df.where(ok).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("target").alias("labels"))
    dup = ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"), F.count_if(F.col("labels") > 1).alias("excluded_conflicting_ids"))
    return base.crossJoin(dup)  # one row each


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key): keys that carry more than one label."""
    return df.groupBy(key).agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a != b").select(key)


def consistent(df: DataFrame, id_col: str, key: str, label: str, *position: str) -> DataFrame:
    """Rows without conflicting ids, then the first of each id by the columns of its position, then without keys whose labels conflict. Rows that share
    a position are told apart by no rule of ours: name columns that leave no ties."""
    each = Window.partitionBy(id_col)
    out = df.withColumns({"_same": F.min(label).over(each) == F.max(label).over(each), "_r": F.row_number().over(each.orderBy(*position))})
    out = out.where("_same and _r = 1").drop("_same", "_r")
    return out.join(conflicts(out, key, label), key, "left_anti")


def split_overlap(df: DataFrame, split: str, key: str) -> DataFrame:
    """(pair, shared): keys that two splits have in common; all must be 0."""
    own = df.groupBy(key).agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in ("train", "val", "test")])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    one = own.agg(*[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}&{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f"{a}&{b}").alias("pair"), F.col(f"`{a}&{b}`").alias("shared")) for a, b in pairs])))


def seeded_sample(df: DataFrame, label: str, key: str, k: int, seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    """k rows a label, those with the least seeded hash; reproducible on any layout."""
    pool = df if exclude is None else df.join(exclude, key, "left_anti")
    w = Window.partitionBy(label).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key)
    return pool.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def balanced(df: DataFrame, label: str, key: str) -> DataFrame:
    """Every label repeated up to the count of the largest; `copy` numbers the repeats. The rows that get one more are the first of their
    label by numbered places, for which only counts by partition are collected, so no task sorts a whole label."""
    rows = Stored(df.withColumn("_row", F.monotonically_increasing_id())).read()
    part = F.shiftright("_row", 33).alias("_part")
    counts = rows.groupBy(label, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(label).orderBy("_part")  # one row for each label and partition
    starts = counts.withColumns({"_start": F.sum("n").over(before) - F.col("n"), "_all": F.sum("n").over(Window.partitionBy(label))})
    most = starts.agg(F.max("_all").alias("_most"))  # one row
    within = Window.partitionBy(label, "_part").orderBy("_row")
    placed = rows.withColumn("_part", part).withColumn("_at", F.row_number().over(within))
    sized = starts.crossJoin(F.broadcast(most)).select(F.col(label).alias("_label"), F.col("_part").alias("_p"), "_start", "_all", "_most")
    placed = placed.join(sized, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_p")))
    reps = F.floor(F.col("_most") / F.col("_all")).cast("int") + F.when(F.col("_start") + F.col("_at") <= F.col("_most") % F.col("_all"), 1).otherwise(0)
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(0), reps - 1))).select(*df.columns, "copy")


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder of CSV files for each split, rows in the order of their lines within a file."""
    df.sortWithinPartitions(split, "line").write.mode("overwrite").partitionBy(split).csv(path, header=True, quote='"', escape='"')


def rows_at(df: DataFrame, position: str, wanted: DataFrame) -> DataFrame:
    return df.join(wanted, position, "left_semi")
