import html
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parse, pii, text as tx
from tidemark.operators import brief, clean, drift
from tidemark.plans import text_queries
from tidemark.sources import reviews as source
from tidemark.sources import store, synthetic


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "kind", "secret"),
    [
        ("write to a.b+c@mail.example.org now", "EMAIL", "mail.example"),
        ("see https://x.example/a?b=1 ok", "URL", "x.example"),
        ("my order #A1234567 is late", "ORDER_ID", "1234567"),
        ("account number is 99887766", "ACCOUNT_ID", "99887766"),
        ("CUST-123456 called", "CUSTOMER_ID", "123456"),
        ("ticket 5551234 open", "REFERENCE_ID", "5551234"),
        ("card 4111 1111 1111 1111 was charged", "CARD", "1111 1111"),
        ("call +1 202-555-0143", "PHONE", "555-0143"),
        ("thanks @some_user", "USER", "some_user"),
        ("my name is Anna Larsen", "PERSON", "Larsen"),
        ("ask Dr. Miller", "PERSON", "Miller"),
        ("this is rahul", "PERSON", "rahul"),
    ],
)
def test_redaction(text, kind, secret):
    out, counts = pii.redact_text(text)
    assert secret not in out and counts[kind] >= 1 and f"[{kind}]" in out
    assert pii.redact_text(out)[0] == out


@pytest.mark.parametrize("text", ["up 50% in 2024", "version 5.3.1 is fine", "on 2026-06-01 it broke", "1000000 users", "top 10 of 100", "I am so happy", "this is great"])
def test_harmless_text_is_unchanged(text):
    assert pii.redact_text(text) == (text, {})


def test_ner_spans_are_used_when_sure():
    assert pii.redact_text("hello Bo", ner=lambda s: [(6, 8, 0.95)])[0] == "hello [PERSON]"


def test_leak_scan(spark):
    hits = lambda t: one(spark, t, pii.leak_hits)
    assert hits("x@y.org and 555 123 4567") == ["email", "long_digit_run"]
    assert hits("3333333 and 1000000 and 2026-06-01 and 107.0.1418.62") == []
    assert hits(None) == []


def test_repair_and_tidy(spark):
    assert one(spark, "cafÃ© &amp; more!!!!!!  ?!?!?!\tok", lambda c: tx.tidied(tx.repaired(c))) == "café & more!!! ?!? ok"


def test_repair_query_reads_whole_pages(spark, tmp_path):
    pages = [(1, "x" * 1990 + " cafÃ© &amp; &lt;b&gt; " + "y&amp;" * 500), (2, "short &amp; cafÃ©"), (3, "cafÃ©\n" + "z" * 3000 + " \u4e2d&amp;\u0007"), (4, None), (5, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")

    def brute(h):
        lines = []
        for line in h.split("\n"):
            try:
                lines.append(line.encode("cp1252").decode("utf-8"))
            except UnicodeError:
                lines.append(line)
        return "\n".join(lines)

    want = [(k, None, False) if h is None else (k, "".join(" " if c == "\u0007" else c for c in unicodedata.normalize("NFC", html.unescape(brute(h)))), brute(h) != h) for k, h in pages]
    got = text_queries.text_repair(spark, str(tmp_path)).select("page_id", "repaired", "mojibake").collect()
    assert sorted(map(tuple, got)) == want and [r[2] for r in want] == [True, True, True, False, False]


def test_variants_have_the_one_without_mojibake_repair(spark, tmp_path):
    spark.createDataFrame([(1, "cafÃ© &amp; &eacute;!!!!! ask @some_user"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.variant): r.text for r in text_queries.text_variants(spark, str(tmp_path)).collect()}
    assert len(got) == 18 and got[1, "no_ftfy"] == "cafÃ© & \u00e9!!! ask @user" and got[1, "current"] == "café & \u00e9!!! ask @user" and got[2, "no_ftfy"] == got[2, "current"]
    assert got[1, "no_punct_tidy"] == "café & \u00e9!!!!! ask @user" and got[1, "bracket_placeholders"] == "café & \u00e9!!! ask [USER]" and got[1, "raw_html_ws"] == "cafÃ© & \u00e9!!!!! ask @some_user"
    assert got[1, "mentions_removed"] == "café & \u00e9!!! ask" and got[2, "raw"] is None


def test_reject_reasons(spark):
    df = spark.createDataFrame([(None,), ("  \t",), ("!!!",), ("日本",)], "x string")
    got = [r.y for r in df.select(tx.reject_reason(F.col("x"), tx.tidied(F.col("x"))).alias("y")).collect()]
    assert got == ["null_text", "empty_text", "no_content_after_cleaning", None]


def test_stems(spark):
    df = spark.createDataFrame([("running",), ("fixes",), ("used",), ("king",), ("cats",)], "x string")
    assert [r.y for r in df.select(tx.stem(F.col("x")).alias("y")).collect()] == ["runn", "fixe", "used", "king", "cats"]


def test_batch_report_adds_up(spark):
    rows = [(1, "r1", "Hello there", None), (2, "r2", " hello THERE ", None), (3, "r3", None, None), (4, "r4", "  ", None), (5, "r5", "mail a@b.org", None), (6, "r6", "  ", None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "_pos int, review_id string, text string, created_at timestamp_ntz, platform string, app_version string")
    rep = clean.report(clean.cleaned(df)).first()
    assert rep.conserved and (rep.kept_rows, rep.ingestion_duplicates_removed, rep.null_text, rep.empty_text, rep.rows_with_pii) == (2, 1, 1, 2, 1)


def test_csv_source(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes('﻿ID, Review ,Date,Stars,Version\na1,"Good, ""really""\nnice",2026-06-01T10:00:00Z,4.6,5.1\na1,Again,31/12/2026,x,5.2\nx y,Third,yesterday,,\n,,,,\n'.encode())
    got = {r.review_id: r for r in source.read_csv(spark, str(path)).collect()}
    assert set(got) == {"a1", "U000002", "U000003", "U000004"}
    assert got["a1"].text == 'Good, "really"\nnice' and got["a1"].rating == 5 and str(got["a1"].created_at) == "2026-06-01 10:00:00"
    assert str(got["U000002"].created_at) == "2026-12-31 00:00:00" and got["U000003"].created_at is None


def test_source_router(spark):
    with pytest.raises(ValueError, match="no review source"):
        source.load(spark, "sentiment140")
    with pytest.raises(ValueError, match="unknown"):
        source.load(spark, "table.xlsx")
    with pytest.raises(ValueError, match="no review text"):
        source.normalised(spark.createDataFrame([(1, "a")], "_pos int, other string"))


def test_synthetic_is_reproducible(spark):
    a, b = (synthetic.generate(spark).orderBy("_pos").toPandas() for _ in range(2))
    assert a.equals(b) and a.gt_pii.notna().mean() > 0.03 and a.review_id.is_unique


def test_store_swaps_and_registers(spark, tmp_path):
    root = str(tmp_path)
    for n in (3, 5):
        store.write_batch(spark, root, "b", {"meta": spark.range(n).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))})
    store.register(spark, root, "b", {})
    assert store.read_table(spark, root, "b", "meta").count() == 5 and store.active(spark, root) == "b"
    with pytest.raises(KeyError):
        store.activate(spark, root, "c")


def paths_outside(d, n, m):
    """The share of all orders of two samples whose largest distance reaches d, path by path."""
    from fractions import Fraction
    from itertools import combinations

    hit = total = 0
    for at in combinations(range(n + m), n):
        i = j = 0
        far = Fraction(0)
        for k in range(n + m):
            i, j = (i + 1, j) if k in at else (i, j + 1)
            far = max(far, abs(Fraction(i, n) - Fraction(j, m)))
        total += 1
        hit += far >= Fraction(d)
    return hit / total


@pytest.mark.parametrize(("n", "m"), [(3, 4), (5, 5), (2, 6), (4, 6), (1, 3)])
def test_ks_p_values_are_exact(n, m):
    from fractions import Fraction
    from math import lcm

    for k in range(1, lcm(n, m) + 1):  # distances that occur
        assert drift.ks_p_value(k / lcm(n, m), n, m) == pytest.approx(paths_outside(Fraction(k, lcm(n, m)), n, m)), k


def test_ks_p_values_meet_the_series():
    far = 1.3 * (2 / 9000) ** 0.5
    assert drift.ks_p_value(round(far * 9000) / 9000, 9000, 9000) == pytest.approx(drift.ks_p_value(round(far * 9000) / 9000, 9000, 10_001), rel=0.2)


def test_ks_p_values():
    assert drift.ks_p_value(1.0, 2, 2) == pytest.approx(1 / 3)
    assert drift.ks_p_value(0.0, 5, 7) == pytest.approx(1.0)
    assert drift.ks_p_value(0.5, 20_000, 20_000) < 1e-12


def test_psi_known_value(spark):
    counts = spark.createDataFrame([("a", 50, 90), ("b", 50, 10)], "category string, ref_n long, cur_n long")
    got = drift.categorical(counts, drift.spine(spark, ["a", "b"])).first()
    assert got.value == pytest.approx(0.8789, abs=1e-4) and got.status == "significant"


@pytest.mark.parametrize(("ref", "cur", "status"), [(100, 110, "none"), (100, 130, "moderate"), (100, 200, "significant"), (0, 5, "significant"), (0, 0, "none")])
def test_volume(spark, ref, cur, status):
    v = spark.createDataFrame([(ref, cur)], "a long, b long").select(drift.volume(F.col("a"), 14, F.col("b"), 14).alias("v")).first().v
    assert v.status == status and (v.value is None) == (ref == 0)


SHEET = {
    "slots": {"total_reviews": 1200, "E1.name": "Payment Failure", "E1.current": 90, "E1.previous": 30, "D1.name": "Login", "D1.current": 5},
    "emerging": [{"key": "E1", "name": "Payment Failure", "status": "EMERGING"}], "declining": [{"key": "D1", "name": "Login"}], "allowed_review_ids": ["R001", "U000002"], "allowed_theme_names": ["Payment Failure", "Login"],
}
GOOD = "SUMMARY: Of {total_reviews} reviews, {E1.name} rose from {E1.previous} to {E1.current} mentions.\nINVESTIGATE:\n- Look into {E1.name} reports such as U000002."


@pytest.mark.parametrize(
    ("old", "new", "failed"),
    [("", "", None), ("{total_reviews}", "1,200", "no_raw_digits"), ("{E1.current} mentions", "{E1.what} mentions", "known_slots"), ("U000002", "R99999", "known_review_ids"), ("rose", "fell", "direction"), ("mentions.", "mentions due to a bug.", "no_causal"), ("Of", "We definitely see, of", "hedged"), ("INVESTIGATE:", "", "format"), ("mentions.", 'mentions of "Some Theme".', "known_theme_names"), ("{E1.name} rose", "{D1.name} rose", "coverage")],
)
def test_brief_validator(old, new, failed):
    got = brief.validate(GOOD.replace(old, new) if old else GOOD, SHEET)
    assert got["passed"] if failed is None else failed in got["failed"], got


def test_split_is_stable(spark):
    assert one(spark, " Hello ", parse.split_by_sha) == one(spark, "hello", parse.split_by_sha)


def unguarded(text):
    """The steps of redaction without looking first for what they need."""
    needs, words = dict(pii._NEEDS), dict(pii._CUE_WORDS)
    try:
        pii._NEEDS.update({k: lambda s: True for k in needs})
        digit, pii._DIGIT = pii._DIGIT, None
        pii._NEEDS.update({k: lambda s: True for k, _ in pii.PATTERNS})
        pii._CUE_WORDS.update({k: ("",) for k in words})
        pii._DIGIT = digit
        return pii.redact_text(text)
    finally:
        pii._NEEDS.clear()
        pii._NEEDS.update(needs)
        pii._CUE_WORDS.clear()
        pii._CUE_WORDS.update(words)


def test_looking_first_skips_no_step():
    import random

    rng = random.Random(6)
    bits = "a.b@c.org www.x.io http://y x.com/q [URL] /z order #77112 ACC-99112 CUST-5512 ticket 5551234 4111 1111 1111 1111 +1 202-555-0143 @me ] Mr Smith Dr. Miller my NAME is Anna name's bob signed, Regards, omar sincerely This is Rahul Jain ı am Karen ſigned amit call me Im from it's From Priya 12345 ٣٤٥٦٧٨ # ( ) . -".split(" ")
    for _ in range(3000):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.redact_text(text) == unguarded(text), text


def test_blake_split_matches_its_definition(spark):
    import hashlib

    keys = ["a", "b c", "", "é", "x" * 500]
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", parse.split_by_blake()(F.col("k")).alias("s")).collect()}
    for k in keys:
        v = int.from_bytes(hashlib.blake2b(f"42:{k}".encode(), digest_size=8).digest(), "big") % 1000
        assert got[k] == ("train" if v < 800 else "val" if v < 900 else "test")


def test_encoding_is_found_line_by_line(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("text\ncafé\n".encode())
    (tmp_path / "b.csv").write_bytes("text\nok\ncafé\n".encode("latin-1"))
    assert source.encoding_of(spark, str(tmp_path / "a.csv")) == "UTF-8" and source.encoding_of(spark, str(tmp_path / "b.csv")) == "ISO-8859-1"
    assert [r.text for r in source.read_csv(spark, str(tmp_path / "b.csv")).orderBy("_pos").collect()] == ["ok", "café"]


def test_even_sample_and_balance(spark):
    from tidemark.operators import profile

    df = spark.range(1000).select(F.col("id").alias("_pos"), F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 7 == 0, None).otherwise("b").alias("label")).repartition(6)
    assert sorted(r._pos for r in clean.even_sample(df, 5).collect()) == [0, 250, 500, 749, 999]
    assert clean.even_sample(df, 2000).count() == 1000 and clean.even_sample(df.limit(0), 5).count() == 0
    out = profile.balanced(df, "label", "_pos")
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert len(set(counts.values())) == 1 and out.select("_pos").distinct().count() == 1000 and out.columns == ["_pos", "label", "copy"]
    times = out.groupBy("_pos", "label").count().groupBy("label").agg(F.max("count").alias("hi"), F.min("count").alias("lo")).collect()
    assert all(r.hi - r.lo <= 1 for r in times)


def test_macro_recall_of_a_sweep(spark):
    from tidemark.operators import scoring

    df = spark.createDataFrame([(0.0, 0.0)] * 8 + [(1.0, 0.0)] * 2, "_y double, prediction double")
    assert scoring.MacroRecall().evaluate(df) == 0.5
    words = {"negative": "bad awful broken", "neutral": "plain usual average", "positive": "good great lovely"}
    rows = [(w, k) for k, said in words.items() for w in said.split() for _ in range(6)]
    best = scoring.sweep(spark.createDataFrame(rows, "text string, label string"), folds=2)
    assert 0.7 < max(best.avgMetrics) <= 1.0


def test_predicted_classes_go_by_name(spark):
    from tidemark.operators import scoring

    rows = [("good fine", "positive"), ("bad poor", "negative")] * 20
    model = scoring.train(spark.createDataFrame(rows, "text string, label string"), 1 << 8)
    got = scoring.predict(spark.createDataFrame([("good fine", "x"), ("bad poor", "y")], "text string, label string"), model).collect()
    assert [(r.label, r.sentiment, r.p_neutral) for r in got] == [("x", "positive", 0.0), ("y", "negative", 0.0)] and all(abs(r.p_negative + r.p_positive - 1) < 0.001 for r in got)


def test_batch_sentiment_without_labels(spark):
    from tidemark.operators import evaluate

    df = spark.createDataFrame([("positive", None, None, 0.1, 0.2, 0.7)], "sentiment string, gt_sentiment string, rating int, p_negative double, p_neutral double, p_positive double")
    assert evaluate.batch_sentiment(df).count() == 0 and evaluate.truth_source(df).first()[0] == "none"


def test_template_says_what_there_is():
    issue = {"key": "E1", "name": "Payment", "status": "EMERGING", "current": 90, "previous": 30, "growth_label": "+200%", "negative_pct": 95.0, "trend": "rising", "evidence_review_ids": ["R1", "R2", "R3", "R4"], "quotes": [], "calculation": {"growth": "(90 - 30) / 30 x 100 = 200.0%"}, "associations": [{"statement": "much of it on web."}]}
    sheet = {
        "slots": {"total_reviews": 1200, "n_themes": 3, "negative_pct": 40.0, "neutral_pct": 10.5, "positive_pct": 49.5}, "overview": {"first_ts": "2026-06-01 00:00", "last_ts": "2026-08-23 00:00"}, "emerging": [issue],
        "top_complaints": [{"name": "Payment", "negative_count": 1100, "size": 1150, "negative_pct": 95.7, "growth_label": None}], "declining": [], "drift": {"theme": "significant", "volume": "none"}, "window_days": 14, "synthetic": True, "scores": {"accuracy": 0.9616, "macro_recall": 0.9207},
    }
    got = brief.template(sheet)
    assert got["executive_summary"] == (
        "Across 1,200 reviews (2026-06-01 to 2026-08-23), 40% are negative, 10.5% neutral and 49.5% positive, grouped into 3 themes. Emerging complaints in the latest 14-day window: "
        "Payment (+200%, 30 to 90 mentions). The largest complaint theme by negative volume is Payment (1,100 negative of 1,150 mentions)."
    )
    assert got["emerging_complaints"] == ["Payment [EMERGING]: 30 -> 90 mentions (+200%); 95% negative; trend rising. Calculation: (90 - 30) / 30 x 100 = 200.0%."]
    assert got["top_complaints"][0].endswith("window change n/a.") and got["possible_associations"] == ["much of it on web."]
    assert got["suggested_investigation_areas"][0].startswith("Review the 90 current-window Payment reports (evidence IDs R1, R2, R3) to confirm") and "theme drift" in got["suggested_investigation_areas"][1]
    assert got["caveats"][2].startswith("This batch is synthetic") and got["caveats"][3].endswith("accuracy 96.2%, macro recall 92.1%.")
    bare = brief.template({**sheet, "emerging": [{**issue, "status": "NEW", "associations": None, "calculation": None}], "overview": {}, "drift": {}, "synthetic": False, "scores": {}})
    assert "Payment (new: 90 mentions vs 0)" in bare["executive_summary"] and bare["possible_associations"][0].startswith("No segment") and len(bare["caveats"]) == 2


def test_synthetic_volumes_follow_their_plan(spark):
    import numpy as np

    df = synthetic.generate(spark).where("gt_theme != 'invalid'")
    assert df.select("gt_theme").distinct().count() == len(synthetic.THEMES) == 16
    by = {(r.gt_theme, r.late): r["count"] for r in df.groupBy("gt_theme", (F.col("created_at") >= "2026-08-10").alias("late")).count().collect()}
    assert ("payment_failure", False) not in by and by["payment_failure", True] > 60  # planted in the last two weeks
    assert by["login_problems", True] < by["login_problems", False] / 5 and 3500 < df.count() < 5000
    u = [(k + 0.5) / 4000 for k in range(4000)]
    n = np.array([r.n for r in spark.createDataFrame([(x,) for x in u], "u double").select(synthetic.poisson(F.lit(7.5), F.col("u")).alias("n")).collect()])
    assert abs(n.mean() - 7.5) < 0.02 and abs(n.var() - 7.5) < 0.1
    assert {r.n for r in spark.createDataFrame([(0.4,)], "u double").select(synthetic.poisson(F.lit(0.0), F.col("u")).alias("n")).collect()} == {0}


DATES = [
    ("2026-06-01T10:20:30Z", "2026-06-01 10:20:30"), ("2026-06-01T10:20:30+05:30", "2026-06-01 04:50:30"), ("2026-06-01", "2026-06-01 00:00:00"), ("06/07/2026", "2026-07-06 00:00:00"), ("12/25/2026", "2026-12-25 00:00:00"),
    ("25-12-2026", "2026-12-25 00:00:00"), ("2026/01/02", "2026-01-02 00:00:00"), ("05/06/2026 07:08", "2026-06-05 07:08:00"), ("12/25/2026 07:08", "2026-12-25 07:08:00"), ("20260601", "2026-06-01 00:00:00"), ("2026-06-01 10:20", "2026-06-01 10:20:00"),
    ("yesterday", None), ("now", None), ("2026", None), ("", None), (None, None), ("31/02/2026", None), ("2026-13-01", None),
]
RATINGS = [("4.6", 5), ("4.5", 4), ("3.5", 4), (" 2 ", 2), ("x", None), ("", None), (None, None), ("inf", None), ("nan", None), ("-1", -1)]
LABELS = [("NEG", "negative"), ("pos", "positive"), ("0", "negative"), ("1", "negative"), ("2", "neutral"), ("3", "neutral"), ("4", "positive"), ("5", "positive"), ("Neutral", "neutral"), ("6", None), ("", None), (None, None)]


def test_fixed_examples_of_dates_ratings_labels_and_names(spark):
    from tidemark.functions import parse

    for rows, f in ((DATES, parse.any_date), (RATINGS, lambda c: parse.rating(F.coalesce(c, F.lit("")))), (LABELS, parse.label)):
        got = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "i int, v string").select("i", f(F.col("v")).cast("string").alias("x")).orderBy("i").collect()
        assert [r.x for r in got] == [None if w is None else str(w) for _, w in rows]
    names = ("my file.csv", "../x", "é", "a.CSV", "n" * 90)
    got = spark.createDataFrame([(n,) for n in names], "n string").select(parse.safe_filename(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["my_file.csv", ".._x.csv", "_.csv", "a.CSV", "n" * 80 + ".csv"]
