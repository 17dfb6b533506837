"""Suffix-array dedup against a dictionary of strings: hot anchors, shards beyond the budget, long texts, repeated rows and null ids."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import prose
from tidemark.llm import induced, suffix

LEAST = -(1 << 63)


def sample():
    rng = random.Random(51)
    passage = prose(rng, 40)
    rows = [(k, prose(rng, rng.randrange(5, 40)) + " " + passage[rng.randrange(60) :] + " " + prose(rng, 10)) for k in range(70)]
    rows += [(100 + k, passage + (" " + prose(rng, 4)) * (k % 3)) for k in range(12)]  # an anchor with very many contexts
    rows += [(200, None), (201, ""), (202, "x" * 99), (203, "x" * 260), (204, "é" * 150), (205, "x" + "é" * 150), (206, "ab" * 300), (207, passage * 5)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[9][1]), (None, rows[9][1]), (None, passage), (None, None), (300, rows[30][1].upper())]
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({"Kept": F.lit(1), "spans": F.lit(2), "gram": F.lit(3), "parts": F.lit(4)})
    out = suffix.deduplicate(df, **more)
    assert "gram" in out.columns and out.columns.count("kept") == 1
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted((LEAST if r[0] is None else r[0], *r[1:]) for r in got)


def brute(rows):
    return sorted(suffix.brute([(LEAST if k is None else k, t) for k, t in rows]))


@pytest.mark.parametrize("small", [{}, {"HOT": 2}, {"HOT": 1, "BROADCAST_IDS": 0}, {"PIECE": 150, "FLUSH": 100, "HOT": 3}, {"BLOCK_ENTRIES": 20, "SHARD_BYTES": 3000}])
@pytest.mark.parametrize("budget", [suffix.BUDGET, 1500])
def test_removed_bytes(spark, monkeypatch, small, budget):
    for name, value in small.items():
        monkeypatch.setattr(suffix, name, value)
    rows = sample()
    assert found(spark, rows, budget=budget) == brute(rows)


def test_many_texts_under_one_id(spark):
    rng = random.Random(11)
    other = prose(rng, 60)
    rows = [(None, prose(rng, 16)) for _ in range(1500)] + [(None, other), (3, "lead " + other), (7, other + " tail")]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("letters", [2, 4, 20])
def test_shard_beyond_the_budget_recurses(monkeypatch, letters):
    """A shard of several times the budget: its arrays lie in files, the queue spills, and names are sorted by recursion, twice at least."""
    rng = np.random.default_rng(letters)
    word = rng.integers(97, 97 + letters, 400).astype(np.uint8).tobytes()
    texts = []
    for _ in range(60):
        at = rng.integers(0, 250)
        texts.append(word[at : at + 150] + rng.integers(97, 97 + letters, 200).astype(np.uint8).tobytes() + word[at // 2 :][:110])
    rows = [(k, t.decode()) for k, t in enumerate(texts)]
    depth, deepest, spills = [0], [0], [0]
    sort, spill = induced.suffixes, induced.TupleQueue._spill

    def counted(*args, **more):
        depth[0] += 1
        deepest[0] = max(deepest[0], depth[0])
        yield from sort(*args, **more)
        depth[0] -= 1

    def seen(self):
        spills[0] += 1
        spill(self)

    monkeypatch.setattr(induced, "suffixes", counted)
    monkeypatch.setattr(suffix, "suffixes", counted)
    monkeypatch.setattr(induced.TupleQueue, "_spill", seen)
    monkeypatch.setattr(induced, "SEGMENT", 700)
    budget = 4000
    with induced.Space(budget) as space:
        shard = suffix.Shard(space)
        for k in range(0, len(texts), 7):
            part = texts[k : k + 7]
            shard.add(np.arange(k, k + len(part)), np.zeros(len(part), np.int64), pa.array(part, pa.binary()))
        assert shard.size > 5 * budget and shard.files
        gone = list(suffix.repeated(shard, 100, budget, base=64))
        folder = space.folder
        made = space.made
    assert deepest[0] >= 3 and spills[0] > 10 and made > 10 and not __import__("os").path.exists(folder)
    off = {k: np.zeros(len(t), bool) for k, t in enumerate(texts)}
    for row, lo, hi in gone:
        for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist()):
            off[r][a : b + 100] = True
    want = {k: removed for k, _, removed, _, _ in suffix.brute(rows)}
    assert {k: int(v.sum()) for k, v in off.items()} == want and sum(want.values()) > 1000


def test_query(spark, tmp_path):
    rows = [(k, t) for k, (_, t) in enumerate(sample())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = suffix.op1_suffix_dedup(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert sorted(map(tuple, out.collect())) == brute(rows)
