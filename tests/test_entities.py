"""Only texts that may hold an HTML entity go to Python."""

from pyspark.sql import functions as F

from tidemark.functions import text as tx


def test_entities(spark):
    texts = ["no isn&#39;t", "plain never", "a & b", None, "", "&amp;amp; nobody", "&notit; &lt"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [tuple(r) for r in df.select(tx.html_unescaped("x").alias("u"), tx.negations(F.col("x")).alias("n")).collect()]
    assert got == [("no isn't", 2), ("plain never", 1), ("a & b", 0), (None, None), ("", 0), ("&amp; nobody", 1), ("¬it; <", 0)]


def test_texts_without_ampersand_stay_in_spark(spark):
    plan = spark.range(3).select(tx.html_unescaped(F.col("id").cast("string")).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN Contains(" in plan
