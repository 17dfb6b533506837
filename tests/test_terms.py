"""Term scores against a plain count of all terms."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import themes as th


def brute(rows, stop):
    tf = {}
    for theme, text in rows:
        if theme is not None:
            w = [x for x in re.findall("[a-z][a-z]+", (text or "").lower()) if x not in stop]
            tf.setdefault(theme, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    tf = {t: c for t, c in tf.items() if c}
    freq, words = sum(tf.values(), Counter()), {t: sum(c.values()) for t, c in tf.items()}
    average = sum(words.values()) / len(words) if words else 0
    return {(t, x): n / words[t] * math.log(1 + average / freq[x]) for t, c in tf.items() for x, n in c.items()}


def sample(n=400):
    """Words of falling frequency, pairs that stand together, a theme with few words, one with none, repeats and equal scores."""
    rng = random.Random(5)
    vocabulary = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for k in range(n):
        w = rng.choices(vocabulary, weights, k=rng.choice((0, 1, 2, 30)))
        rows.append((k % 3, " ".join(f"{x} own{'abc'[k % 3]} pair{'abc'[k % 3]}" if rng.random() < 0.2 else x for x in w) + ". A b stop x1y"))
    return rows + [(3, "few few few, ha HA ha"), (4, "stop a"), (5, None), (None, "no theme at all"), (6, "ab cd"), (6, "cd ab"), (7, "")]


@pytest.mark.parametrize("k, most", [(1, 10_000), (5, 10_000), (24, 10_000), (24, 3)])
def test_highest_terms_are_exact(spark, k, most):
    rows, stop = sample(), ["stop"]
    want = brute(rows, stop)
    got = {(r.theme, r.term): r.score for r in th.ctfidf(spark.createDataFrame(rows, "theme int, text string"), "theme", "text", stop, k, most).collect()}
    assert all(math.isclose(s, want[x], rel_tol=1e-12) for x, s in got.items())
    for theme in {t for t, _ in want}:
        top = lambda found: sorted((-round(s, 9), x) for (t, x), s in found.items() if t == theme)[:k]  # noqa: E731, B023
        assert top(got) == top(want)


def test_pairs_of_rare_words_are_not_counted(spark):
    """What is counted does not grow with all the pairs that there are."""
    rows = sample()
    want = brute(rows, ["stop"])
    pairs = sum(" " in x for _, x in want)
    got = th.ctfidf(spark.createDataFrame(rows, "theme int, text string"), "theme", "text", ["stop"], 5).where(F.contains("term", F.lit(" "))).count()
    assert pairs > 2000 and got < pairs / 10


def test_empty_tables_have_no_terms(spark):
    assert th.ctfidf(spark.createDataFrame([], "theme int, text string"), "theme", "text", ["stop"]).count() == 0


def test_tokens(spark):
    texts = ["", "a", "It's an [EMAIL] x2yz, ÄBC ab-cd  EF", None, "...", "stop it stop", "İstanbul KKelvin"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    matched = F.regexp_extract_all(F.lower(F.regexp_replace("text", tx.PLACEHOLDER, " ")), F.lit("[a-z][a-z]+"), F.lit(0))
    for stop in ([], ["stop"]):
        rows = df.select(tx.tokens(F.col("text"), stop).alias("got"), matched.alias("all")).collect()
        assert all(r.got == (None if r["all"] is None else [w for w in r["all"] if w not in stop]) for r in rows)
