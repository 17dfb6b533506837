"""Texts go to Python in small batches; copies are found by digests."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean
from tidemark.plans import text_queries
from tidemark.shared import BATCH_ROWS

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("name", ["clean_conservation", "clean_batch", "text_variants", "negation_counts", "pii_redact", "pii_counts_by_type", "text_repair"])
def test_batches_are_small(spark, name):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "10000")
    try:
        text_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(ROWS)) <= BATCH_ROWS
    finally:
        spark.conf.set(ROWS, before)


def test_copies_and_blanks_by_digest(spark):
    at = datetime.datetime(2024, 1, 1)
    texts = ["Ab c", " ab C\t", "ab  c", None, None, "", "  ", "ab c"]
    rows = spark.createDataFrame([(i, t, at, "p", None) for i, t in enumerate(texts)], "_pos long, text string, created_at timestamp_ntz, platform string, app_version string")
    got = clean.deduped(rows)
    assert got.columns == [*rows.columns, "is_duplicate"]
    assert sorted(r._pos for r in got.where("is_duplicate").collect()) == [1, 7]
    kept = rows.withColumns({"text_redacted": F.col("text"), "kept": F.col("text").isNotNull()})
    assert clean.identical_kept(kept).first()[0] == 2
