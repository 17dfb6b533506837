"""The pipeline on a small batch: every stage's decision against a plain version."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_llm import components, prose, shingle_set  # noqa: F401

import random


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng, 80) + (" vile nasty vilest" if i % 8 == 0 else ""), "en", "ab"[i % 2], 1) for i in range(400)]
    rows += [(500, rows[1][1], "en", "a", 1), (501, rows[3][1] + " tail", "en", "a", 1), (502, rows[5][1][:200] + " " + prose(rng, 30), "en", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("vile" in r[1])) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(rows[7][1].split()[10:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, str(tmp_path))
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {r[0] for r in rows if "vile" not in r[1]} and clean.columns == docs.columns
    single = cp.drop_near_duplicates(spark, clean, str(tmp_path))
    comp = components([(r[0], r[1]) for r in rows if r[0] in kept])
    assert {r.doc_id for r in single.collect()} == {k for k, (_, c) in comp.items() if k == c} and single.columns == docs.columns
    pure = cp.drop_benchmark(spark, single, str(tmp_path))
    assert {r.doc_id for r in single.collect()} - {r.doc_id for r in pure.collect()} == {7}
    mixed = cp.mix_sources(spark, pure, str(tmp_path))
    out = cp.shard(spark, mixed, str(tmp_path))
    assert out.count() == mixed.count() and {"shard", "slot"} <= set(out.columns)
    assert cp.run(spark, str(tmp_path)).groupBy("shard").agg(F.count("*")).count() == 24


def test_near_duplicates_of_null_ids_and_repeated_rows(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    mid, end = (d + "".join(f" x{k}" for k in range(n)) for n in (14, 32))  # d and end are linked through mid only
    assert jac(d, mid) >= 0.75 <= jac(mid, end) and jac(d, end) < 0.75
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (4, c), (4, c + " tail"), (None, c), (7, d), (None, mid), (8, end), (None, None), (None, ""), (9, "one two"), (None, "One two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in cp.drop_near_duplicates(spark, docs, "").collect()]
    want = [(1, a), (None, b), (4, c), (7, d), (None, None), (None, ""), (9, "one two")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def jac(p, q):
    x, y = shingle_set(p), shingle_set(q)
    return len(x & y) / len(x | y)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows, labels=(), items=()):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and set(docs.columns) <= set(out.columns), name
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_nulls_in_every_column(spark, tmp_path):
    rng = random.Random(14)
    texts = [prose(rng, 40) for _ in range(30)]
    rows = [(i if i % 3 else None, t, "en" if i % 4 else None, "ab"[i % 2] if i % 5 else None, 1 if i % 2 else None) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (100, "", None, "a", 0), (101, " \n", "en", None, 2), (101, texts[4] + " x", "en", "b", 2), (None, texts[5], "en", "a", 2)]
    tables(spark, tmp_path, rows, [(None, None, None), (1, None, 1), (2, 1, None), (2, 0, 0)], [(None, None), (None, texts[7]), (3, " "), (4, "no such words")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = cp.drop_toxic(spark, docs, str(tmp_path))
    assert kept.count() == len(rows)  # too few labels to learn from
    single = cp.drop_near_duplicates(spark, kept, str(tmp_path))
    assert single.count() == len(rows) - 2
    pure = cp.drop_benchmark(spark, single, str(tmp_path))
    assert pure.count() == len(rows) - 3 and texts[7] not in [r.text for r in pure.collect()]
    mixed = cp.mix_sources(spark, pure, str(tmp_path))
    out = cp.shard(spark, mixed, str(tmp_path))
    assert mixed.columns == docs.columns and out.count() == mixed.count() > 0


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    """Columns named like the operators' own come back with their values, in their order."""
    rng = random.Random(15)
    tables(spark, tmp_path, [(i, prose(rng, 30), "en", "ab"[i % 2], 1) for i in range(12)], [(1, 1, 0)], [(1, "other words")])
    names = ("score", "Leaks", "rowno", "kept", "copy", "n_copies", "shuffle_key", "Shard", "slot", "component_id", "n_shingles", "t", "cdf", "h", "doc", "_mix_n", "predicted", "a.b")
    first = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = first.select("doc_id", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in names[:9]], "text", "lang", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in names[9:]], "source", "n_chars")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        assert rows and out.columns == docs.columns, name
        assert all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in names), name
        assert name == "mixing" or len(rows) == 12
    out = cp.STAGES[-1][1](spark, docs.select(*[c for c in docs.columns if "." not in c]), str(tmp_path))
    assert out.count() == 12 and {"shard", "slot"} <= set(out.columns)
    assert all(r["score"] == f"score:{r['doc_id']}" for r in out.collect())
