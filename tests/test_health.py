"""Data health counts rows as its SQL does, whatever their texts."""

import duckdb
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import clean
from tidemark.plans import catalogue

ODD = [None, "", " ", "\t\n", "\xa0", "x", "X ", "x\xa0", "\x0bx", "!!!", "...", "İ", "i", "i̇", "ΑΣ", "ας", "ασ", "mail a@b.com"]


def odd_rows(spark, n=20):
    texts = F.array(*[F.lit(t) for t in ODD])
    return spark.range(0, n * len(ODD), 1, 3).select(F.col("id").alias("doc_id"), texts[(F.col("id") % len(ODD)).cast("int")].alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))


def test_health_of_odd_texts_matches_sql(spark, tmp_path):
    odd_rows(spark).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = catalogue.QUERIES["data_health"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLES['data_health']})").fetchall()
    assert [tuple(r) for r in got.collect()] == want


def test_cleaning_without_a_key_keeps_its_rules(spark):
    rows = odd_rows(spark, 2).select(F.col("doc_id").alias("_pos"), "text", F.lit(0).alias("created_at"), F.lit("p").alias("platform"), F.lit(None).cast("string").alias("app_version"))
    done = clean.cleaned(rows).collect()
    blank = [r for r in done if r["text"] is None or not r["text"].strip(text.SPACES)]
    assert len(blank) == 10 and not any(r["is_duplicate"] or r["kept"] for r in blank)
    assert all(r["reject_reason"] == ("null_text" if r["text"] is None else "empty_text") for r in blank)
    lenient = clean.cleaned(rows, key=F.lower("text"), reject=False).collect()
    assert all(r["kept"] != r["is_duplicate"] and r["reject_reason"] is None for r in lenient) and sum(r["kept"] and r["text"] is None for r in lenient) == 1
