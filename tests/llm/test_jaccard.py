"""The Jaccard join against brute force: long and heavy columns, rows without ids, repeated ids, very long texts."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import prose, shingle_set
from tidemark.llm import jaccard


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row: rows are linked, not ids."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = known if doc is None else doc if known is None else min(known, doc)
    return sorted(((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def linked(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).withColumns({"Node": F.lit(1), "comp": F.lit(2), "n": F.lit(3), "rowno": F.lit(4)})
    return sorted((tuple(r) for r in jaccard.link(df).collect()), key=repr)


def sample():
    rng = random.Random(41)
    common = prose(rng, 25)  # in very many texts
    rows = [(k, common + " " + prose(rng, rng.randrange(3, 40))) for k in range(60)]
    base = prose(rng, 60).split()
    for k in range(60):  # a large group of near copies, some of them too far from each other
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(300 + k, prose(rng, 30)) for k in range(20)] + [(None, rows[3][1]), (None, rows[70][1] + " tail"), (5, "other text under an id that repeats, with some words"), (5, "x"), (400, None), (401, ""), (None, " ")]
    return rows


@pytest.mark.parametrize("small", [{}, {"SHORT": 2}, {"SHORT": 2, "HEAVY": 7}, {"SHORT": 2, "HEAVY": 3, "SEGMENT_LEAST": 5, "SEGMENT_MOST": 5, "BLOCK_POSTINGS": 50}, {"BROADCAST_IDS": 0, "HOT_LEAST": 1000}])
def test_links(spark, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = sample()
    assert linked(spark, rows) == brute(rows)


def test_links_through_rows_without_an_id(spark):
    rng = random.Random(12)
    d = prose(rng, 80)
    mid, end = (d + "".join(f" x{k}" for k in range(n)) for n in (14, 32))
    rows = [(1, d), (None, mid), (2, end)]
    assert linked(spark, rows) == [(1, 76, 1), (2, 108, 1), (None, 90, 1)] == brute(rows)


def test_very_long_and_empty(spark):
    rng = random.Random(13)
    text = prose(rng, 150_000)  # over a run of rows that is read at once
    rows = [(1, text), (2, text[:-3000]), (3, "short text"), (4, text[: len(text) // 2])]
    got = {r[0]: r[2] for r in linked(spark, rows)}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert linked(spark, []) == []


def test_query(spark, tmp_path):
    rows = [(k, t) for k, (_, t) in enumerate(sample())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = jaccard.op4_jaccard(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)
