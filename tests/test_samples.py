"""Capped samples, the leak scan of their strings, report files, and the figures of stages."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.operators import samples
from tidemark.plans.batch import Stages
from tidemark.sources import store


def test_lists_are_capped_at_every_depth(spark):
    body = {"a": [1, [1, 2, 3, 4, 5], {"b": ["x"] * 4}, 4, 5], "c": "é\n\"", "d": None, "e": {}, "f": []}
    df = spark.createDataFrame([(json.dumps(body),), (None,), ("[]",), ("3",)], "body string")
    got = [r[0] for r in df.select(samples.capped(F.col("body"))).collect()]
    assert json.loads(got[0]) == {"a": [1, [1, 2, 3, "... 2 more"], {"b": ["x", "x", "x", "... 1 more"]}, "... 2 more"], "c": "é\n\"", "d": None, "e": {}, "f": []}
    assert got[1:] == [None, "[]", "3"] and "é" in got[0]
    assert json.loads(df.select(samples.capped(F.col("body"), 1, marker=False)).first()[0])["a"] == [1]


def test_samples_of_views(spark):
    rows = spark.range(10).select("id", F.array(*[F.lit(k) for k in range(5)]).alias("many"), F.lit(None).cast("string").alias("none"))
    got = {r.name: json.loads(r.body) for r in samples.samples({"last": rows.orderBy(F.desc("id")), "one": rows.where("id = 4"), "empty": rows.limit(0)}, cap=2).collect()}
    row = lambda k: {"id": k, "many": [0, 1, "... 3 more"], "none": None}
    assert got == {"last": [row(9), row(8), "... 8 more"], "one": [row(4)], "empty": []}


def test_leaks_by_path_without_values(spark):
    body = json.dumps({"a@b.org": 1, "x": ["fine", {"y": "call 555 123 4567 or a@b.org"}], "n": 5551234567, "z": None})
    out = samples.leaks(spark.createDataFrame([(1, body), (2, None), (3, "[]")], "id long, body string"))
    assert out.columns == ["id", "path", "pattern"]
    assert sorted(map(tuple, out.collect())) == [(1, "$.x[1].y", "email"), (1, "$.x[1].y", "long_digit_run")]


def test_report_files(spark, tmp_path):
    reports = spark.createDataFrame([("overview", '{"n": 1, "é": [null]}'), ("a/b", "[1]")], "key string, data string")
    assert store.write_reports(spark, str(tmp_path / "r"), reports) == [f"{tmp_path}/r/overview.json", f"{tmp_path}/r/a_b.json"]
    store.write_reports(spark, str(tmp_path / "r"), reports.where("key = 'a/b'").withColumn("data", F.lit("[2]")))
    assert json.loads(Path(tmp_path / "r/overview.json").read_text()) == {"n": 1, "é": [None]} and json.loads(Path(tmp_path / "r/a_b.json").read_text()) == [2]


def test_figures_of_stages(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    stages = Stages(spark)
    df = spark.read.parquet(f"{tmp_path}/t")
    stages.run("kept", lambda: df.where("id % 2 = 0").write.parquet(f"{tmp_path}/u"))
    n = stages.run("sorted", lambda: len(df.repartition(3, "id").sortWithinPartitions("id").collect()))
    lazy = stages.run("nothing", df.where, "id = 1")
    assert n == 1000 and lazy.count() == 1 and set(stages.figures) == {"kept", "sorted", "nothing"}
    kept, ordered, nothing = (stages.figures[k] for k in ("kept", "sorted", "nothing"))
    assert (kept["rows_in"], kept["rows_out"], kept["shuffle_bytes"]) == (1000, 500, 0)
    assert ordered["rows_in"] == 1000 and ordered["shuffle_bytes"] > 0 and ordered["peak_task_bytes"] > 0
    assert nothing["jobs"] == nothing["rows_in"] == 0 and kept["jobs"] >= 1 and min(f["peak_driver_mb"] for f in stages.figures.values()) > 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    json.dumps(stages.figures)
