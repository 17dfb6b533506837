"""Cleaning is one pass of Python over a text, with the results of the columns it stands for."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import pii, text as tx
from tidemark.operators import clean
from tidemark.plans import text_queries

ODD = [
    "", " \t ", "plain", "a\u0000b​c﻿ d\x85e\x1cf", "No!!!!! way???? ok....... ?!?!?!? !!?", "cafÃ© &amp; tÃ©a", "&lt;b&gt; &nbsp;x", "é #tag #ü_1 ‍",
    "mail a.b@example.org, see www.example.org/x or HTTPS://x.io and call +1 202-555-0147", "#[URL] [USER] @me order no 12345 four 4444", "I'm Anna Larsen from Oslo", " x　 y ", "İ WWW.a.co K",
]


def _pythons(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") + plan.count("MapInArrow")


@pytest.mark.parametrize("name", ["clean_conservation", "clean_repairs", "clean_batch", "text_variants"])
def test_one_python_pass(spark, name):
    assert _pythons(text_queries.QUERIES[name](spark, "/root/testdata/sf0.001")) == 1


def test_cleaned_is_what_the_columns_give(spark):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([*ODD, None])], "_pos long, text string, created_at timestamp_ntz, platform string, app_version string")
    red = pii.redacted(tx.repaired(F.col("text")))
    want = df.select("_pos", tx.tidied(red["text"]).alias("t"), red["counts"].alias("c"), tx.is_mojibake("text").alias("m"))
    got = {r._pos: r for r in clean.cleaned(df).collect()}
    for r in want.collect():
        one = got[r._pos]
        if one.kept:
            assert (one.text_redacted, one.pii_counts, one.was_mojibake) == (r.t, r.c, r.m)
    assert got[5].was_mojibake and got[5].had_entities and got[6].had_entities and not got[2].had_entities
    assert {p: r.reject_reason for p, r in got.items() if r.reject_reason} == {0: "empty_text", 1: "empty_text", len(ODD): "null_text"}


def test_variants_are_what_the_columns_give(spark, monkeypatch):
    monkeypatch.setattr(clean, "VARIANTS_BYTES", 40)  # several batches leave Python
    df = spark.createDataFrame(list(enumerate([*ODD, None])), "doc_id long, text string")
    red, plain = pii.redacted(tx.repaired(F.col("text")))["text"], pii.redacted(tx.unrepaired(F.col("text")))["text"]
    cur = tx.tidied(red)
    variants = {
        "current": tx.model_input(cur), "no_ftfy": tx.model_input(tx.tidied(plain)), "no_punct_tidy": tx.model_input(tx.squeezed(red)), "urls_removed": tx.model_input(tx.squeezed(F.replace(cur, F.lit("[URL]"), F.lit("")))),
        "mentions_removed": tx.model_input(tx.squeezed(F.replace(cur, F.lit("[USER]"), F.lit("")))), "hashtag_plain": tx.model_input(F.regexp_replace(cur, r"(?U)#(\w+)", "$1")), "bracket_placeholders": cur,
        "raw_html_ws": tx.squeezed(tx.html_unescaped(F.col("text"))), "raw": F.col("text"),
    }
    want = {(r.doc_id, k): r[k] for r in df.select("doc_id", *[v.alias(k) for k, v in variants.items()]).collect() for k in variants}
    assert {(r.doc_id, r.variant): r.text for r in clean.variants(df, "doc_id", "text").collect()} == want
