"""The decision table on hand-made batches: windows end at END, counts are spread evenly over a range of days."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import radar

END = datetime(2026, 8, 23, 12)
SCHEMA = "review_id string, created_at timestamp_ntz, theme_id string, sentiment string, confidence double, similarity double, app_version string, platform string"


def spread(n, near, far, theme="t", sentiment="negative", tag="x", **more):
    step = (far - near) / max(1, n)
    return [(f"{theme}-{tag}-{i}", END - timedelta(days=near + step * i), theme, sentiment, 0.9, i / 1000, more.get("version"), more.get("platform")) for i in range(n)]


def batch(current, previous, theme="t", sentiment="negative", **more):
    return spread(current, 0.01, 13.99, theme, sentiment, "c", **more) + spread(previous, 14.01, 27.99, theme, sentiment, "p", **more)


BASE = spread(40, 0.0, 40, "base", "positive", "b")  # covers both windows, and END itself


def decide(spark, rows, theme="t", p=radar.Params(), base=BASE):
    df = spark.createDataFrame(rows + base, SCHEMA)
    themes = spark.createDataFrame([(theme, "Theme")], "theme_id string, name string")
    return radar.decided(df, themes, p, END).first()


@pytest.mark.parametrize(
    ("previous", "current", "status", "growth"),
    [(100, 200, "EMERGING", 100.0), (100, 50, "DECLINING", -50.0), (100, 100, "STABLE", 0.0), (500, 540, "STABLE", 8.0), (2, 5, "INSUFFICIENT_EVIDENCE", 150.0)],
)
def test_growth_statuses(spark, previous, current, status, growth):
    got = decide(spark, batch(current, previous))
    assert (got.status, got.growth_pct) == (status, growth)


def test_new_has_no_growth(spark):
    got = decide(spark, batch(100, 0))
    assert (got.status, got.growth_pct, got.growth_label, got.priority) == ("NEW", None, "NEW", 400.0)


def test_priority_uses_growth(spark):
    got = decide(spark, batch(142, 50))
    assert got.growth_pct == 184.0 and got.priority == pytest.approx(142 * 2.84)


def test_positive_theme_is_no_complaint(spark):
    assert decide(spark, batch(142, 50, sentiment="positive")).status == "NOT_A_COMPLAINT"


def test_no_previous_window(spark):
    assert decide(spark, spread(200, 0.01, 10), base=[]).status == "INSUFFICIENT_EVIDENCE"


def test_theme_without_reviews_is_reported(spark):
    assert decide(spark, [], theme="none").status == "NO_DATA"


def test_malformed_dates_are_counted_not_used(spark):
    rows = batch(100, 100) + [("bad1", None, "t", "negative", 0.9, 0.1, None, None)]
    one = radar.anchors(spark.createDataFrame(rows, SCHEMA)).first()
    assert one.malformed == 1 and one.dated == 200


def test_no_dated_review_gives_no_rows(spark):
    df = spark.createDataFrame([("a", None, "t", "negative", 0.9, 0.1, None, None)], SCHEMA)
    assert radar.decided(df, spark.createDataFrame([("t", "T")], "theme_id string, name string")).count() == 0


def test_soft_decline_needs_a_falling_trend(spark):
    falling = [r for k, n in enumerate([39, 40, 48, 50, 55, 60, 70, 80]) for r in spread(n, 7 * k + 0.01, 7 * k + 6.99, tag=f"w{k}")]
    got = decide(spark, falling, base=spread(1, 0, 0, "base", "positive"))
    assert (got.status, got.trend) == ("DECLINING", "falling")


def test_bucket_start_is_outside(spark):
    rows = [("a", END, "t", "negative", 0.9, 0.1, None, None), ("b", END - timedelta(days=14), "t", "negative", 0.9, 0.1, None, None)]
    got = radar.placed(spark.createDataFrame(rows, SCHEMA)).select("review_id", "bucket").collect()
    assert {r.review_id: r.bucket for r in got} == {"a": 1, "b": None}


def test_series_helpers(spark):
    df = spark.createDataFrame([([10, 20, 40, 80],), ([5, 5],), ([0, 0, 0],)], "w array<long>").select(radar.trend(F.col("w")).alias("t"), radar.acceleration(F.col("w")).alias("a"))
    assert [tuple(r) for r in df.collect()] == [("rising", 0.0), ("insufficient_periods", None), ("insufficient_periods", None)]


def test_evidence_order_and_size(spark):
    rows = radar.placed(spark.createDataFrame(batch(50, 50) + BASE, SCHEMA), as_of=END)
    got = radar.evidence(rows).where("theme_id = 't'").orderBy("rank").collect()
    assert [r.review_id for r in got] == [f"t-c-{i}" for i in range(49, 44, -1)]


def test_lift_is_called_an_association(spark):
    rows = batch(40, 40, version="5.3") + batch(60, 60, theme="u", version="5.2")
    df = spark.createDataFrame(rows, SCHEMA)
    out = radar.radar(df, spark.createDataFrame([("t", "Theme"), ("u", "Other")], "theme_id string, name string"), as_of=END)
    text = out.where("theme_id = 't'").first().associations[0].statement
    assert "app_version=5.3" in text and text.endswith("not evidence of cause.")


def test_rules_text_names_the_missing_window():
    assert "does not reach back" in radar.rules_text()
