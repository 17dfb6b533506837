"""Toxicity: bounded fitting, the risk estimator against a plain one. Sharding: the matrix beyond the library's limit, the queries' columns."""

import collections
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import tidemark.llm.toxicity as tox
from tests.llm.test_llm import prose
from tidemark.llm import shards


def test_sample_is_bounded_by_rows(spark):
    rows = [(1, f"text {k % 300}") for k in range(3000)] + [(2, "same")] * 500 + [(3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(tox._sampled(df, 40, 3)) == 40
    assert len(tox._sampled(df.where("doc_id > 1"), 40, 3)) == 3
    assert len(tox._sampled(df.limit(0), 40, 3)) == 0


def plain_risk(w, b, pos, unl, prior):
    f = lambda doc: b + sum(w.get(int(p), 0.0) for p in doc)
    soft = lambda z: np.log1p(np.exp(-abs(z))) + max(z, 0)
    plus = prior * np.mean([soft(-f(d)) for d in pos])
    minus = np.mean([soft(f(d)) for d in unl]) - prior * np.mean([soft(f(d)) for d in pos])
    return plus + max(0.0, minus)


def test_training_lowers_the_non_negative_risk():
    rng = random.Random(5)
    unl = [np.unique([rng.randrange(400) for _ in range(30)] + ([401, 402] if k % 10 == 0 else [])) for k in range(400)]
    pos = [np.unique([rng.randrange(400) for _ in range(30)] + [401, 402]) for _ in range(60)]
    model = tox.train(pos, unl, 0.1)
    w = dict(zip(model.places.tolist(), model.weights.tolist()))
    assert {401, 402} <= set(w)
    start = plain_risk({}, float(np.log(0.1 / 0.9)), pos, unl, 0.1)
    assert plain_risk(w, model.bias, pos, unl, 0.1) < 0.6 * start
    assert tox.train([], unl, 0.1).bias == -40 and tox.train(pos, unl, 0.0).bias == -40


def test_toxicity_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) + (" vile nasty vilest" if i % 8 == 0 else "")) for i in range(600)] + [(700, None), (701, ""), (702, prose(rng, 60_000) + " vile nasty vilest")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(600)] + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = tox.op2_toxicity(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 603 and all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for k, r in got.items())
    assert all(got[i].predicted == int(i % 8 == 0) for i in range(600)) and got[702].predicted == 1 and got[700].score == got[701].score


def test_matrix_beyond_the_librarys_limit(monkeypatch):
    monkeypatch.setattr(shards, "EXACT_LIMIT", 20)
    counts, cells = np.array([50, 0, 17, 90, 3]), np.array([40, 41, 39, 40])
    rows = np.array([[shards.matrix_row(i, counts, cells, seed) for i in range(5)] for seed in range(400)])
    assert (rows.sum(2) == counts).all() and (rows.sum(1) == cells).all() and rows.min() >= 0
    assert np.abs(rows.mean(0) - counts[:, None] * cells[None] / 160).max() < 1.0


def test_shard_query(spark, tmp_path):
    rows = [(i, "é" * (i % 5) if i % 7 else None, "en", "s", 1) for i in range(1000)] + [(1, "twice", "en", "s", 1)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = shards.op8_shard(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    got = out.collect()
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    sizes = collections.Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    # no shard takes to an end of the table
    assert all(300 < np.mean([r.doc_id for r in got if r.shard == s]) < 700 for s in sizes)
    assert shards.shuffle_into_shards(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), 24).agg(F.count("*")).first()[0] == 0
