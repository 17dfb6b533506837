"""Decontamination, mixing and chat formatting: items and rows without ids, mixed layouts, long conversations, other folders."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import prose, shingle_set, words
from tidemark.llm import chat, containment, mixing

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def contained(docs, items):
    want = set()
    for k, t in docs:
        have, w = shingle_set(t), words(t)
        for i, q in items:
            s, n = shingle_set(q), len(words(q))
            runs = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if 0 < n < 5 else have if len(w) >= 5 else set()
            if s and 100 * len(s & runs) >= 75 * len(s):
                want.add((k, i))
    return want


@pytest.mark.parametrize("block", [20_000, 7])
def test_short_items_are_all_found(spark, monkeypatch, block):
    monkeypatch.setattr(containment, "ITEM_BLOCK", block)
    rng = random.Random(21)
    items = [(i, prose(rng, 1 + i % 13)) for i in range(60)] + [(None, "two words"), (None, "no id but many words in it"), (77, "two words"), (78, None), (79, " ")]
    docs = [(k, prose(rng, 30) + " " + (items[rng.randrange(len(items))][1] or "") + " " + prose(rng, 30)) for k in range(300)]
    docs += [(300, "Two  WORDS"), (301, None), (302, ""), (300, "two words again"), (303, "so no id but many words in it\n too")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"Leaks": F.lit(1), "item_id": F.lit(2)})
    out = containment.leaks(df, spark.createDataFrame(items, "item_id long, text string").withColumn("leaks", F.lit(0)))
    got = [(r.doc_id, r.text, x.item_id) for r in out.collect() for x in r.leaks]
    want = [(k, t, i) for k, t in docs for _, i in contained([(k, t)], items)]
    assert set(got) == set(want) and any(i is None for *_, i in got) and out.columns == ["doc_id", "text", "item_id", "leaks"]


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The query runs from another folder, with the package on the driver's path alone."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = [(i, " ".join(f"w{{(i * 7 + k) % 90}}" for k in range(60)), "en", "ab"[i % 2], 1) for i in range(40)]
spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet("documents.parquet")
spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet("benchmark.parquet")
spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet("labels.parquet")
for name in ("op7_decontaminate", "pipeline"):
    print(name, entry.queries()[name](spark, ".").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "op7_decontaminate 40" in done.stdout and "pipeline " in done.stdout, done.stderr[-3000:]


def test_mixing_draws_for_each_row_without_an_id(spark):
    rows = [(None, "x" * 10, "a")] * 400 + [(5, "x" * 10, "a")] * 400 + [(10 + i, "x" * 10, "a") for i in range(200)] + [(3000 + i, "y", "b") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"cdf": F.lit(1), "Pieces": F.lit(2), "rate": F.lit(3), "_mix_n": F.lit(4), "copy": F.lit(5)})
    out = mixing.mix(df).cache()
    assert {"cdf", "Pieces", "rate", "copy", "n_copies", "shuffle_key"} <= set(out.columns) and "_mix_n" not in out.columns
    for key in (F.col("doc_id").isNull(), F.col("doc_id") == 5):
        n = out.where(key).count()
        assert 130 < n < 280  # 400 rows at a rate of 0.51
        assert out.where(key).select("shuffle_key").distinct().count() == n
    out.unpersist()
    once = mixing.mix(df.where("doc_id >= 10"))
    assert once.agg(F.max("shuffle_key")).first()[0] is not None


def test_mixing_at_great_rates(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x" * 3, "big"), (2, "y", "small"), (3, None, "none"), (4, "", None)], "doc_id long, text string, source string")
    plain = mixing.mix(df, {"small": 1.0}, budget=2000.0).select("doc_id", "copy", "n_copies").collect()
    n = len(plain)
    assert 7700 < n < 8300 and {r.doc_id for r in plain} <= {2, 3, 4} and {r.n_copies for r in plain if r.doc_id == 2} == {sum(r.doc_id == 2 for r in plain)}
    assert sorted(r.copy for r in plain if r.doc_id == 2) == list(range(sum(r.doc_id == 2 for r in plain)))
    monkeypatch.setattr(mixing, "CHUNK", 7)
    again = mixing.mix(df, {"small": 1.0}, budget=2000.0).select("doc_id", "copy", "n_copies").collect()
    assert sorted(again) == sorted(plain)
    with pytest.raises(ValueError, match="repeated"):
        mixing.mix(df, {"small": 1.0}, budget=1e12)


RAWS = {
    '{"messages":[{"role":"user","content":"a"},{"content":null,"role":"assistant","x":{"content":1}}],"id":1}': ("messages", [("user", "a"), ("assistant", "")]),
    '{"messages":[]}': ("messages", []),
    '{"messages":[{"role":null,"content":null}]}': ("messages", [("", "")]),
    '{"messages":[1,"a"]}': (None, None),
    '{"messages":[{"meta":{"content":"q"},"role":"x"}]}': (None, None),
    '{"messages":{"role":"a"}}': (None, None),
    '{"prompt":"a","response":null}': ("prompt", [("user", "a"), ("assistant", "")]),
    '{"prompt":"a","response":"b","id":7,"tags":["x"]}': ("prompt", [("user", "a"), ("assistant", "b")]),
    '{"prompt":1.5,"response":"a"}': (None, None),
    '{"system":null,"prompt":"p","response":"r"}': ("system and prompt", [("user", "p"), ("assistant", "r")]),
    '{"instruction":"a","input":null,"output":"b"}': ("instruction and input", [("user", "a"), ("assistant", "b")]),
    '{"conversations":[{"from":"human","value":"a"},{"from":"gpt"}]}': ("from and value", [("user", "a"), ("assistant", "")]),
    "[1]": (None, None),
    "3": (None, None),
    "nope": (None, None),
    "": (None, None),
}


def test_chat_layouts_with_nulls_and_extra_fields(spark):
    df = spark.createDataFrame([(r,) for r in RAWS] * 2 + [(None,)], "raw string").withColumns({"layout": F.lit(1), "turns": F.lit(2)})
    got = chat.canonical_json(df, "raw", ("raw",)).collect()
    assert len(got) == 2 * len(RAWS) + 1
    for r in got:
        turns = None if r.turns is None else [tuple(t) for t in r.turns]
        assert (r.layout, turns) == RAWS.get(r.raw, (None, None)), r.raw
    assert chat.canonical_json(df.limit(0), "raw").count() == 0


def test_chat_spans_of_a_long_conversation(spark):
    rows = [(1, k, ("user", "assistant", "tool")[k % 3], f"t{k} " * (k % 4)) for k in range(700)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    done = chat.format_turns(chat.canonical_table(df))
    for r in done.select("conv_id", "turns", "formatted", "loss_spans").collect():
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [t.text for t in r.turns if t.role == "assistant"]
    empty = spark.createDataFrame([([],), (None,)], "turns array<struct<role:string,text:string>>")
    assert [r.loss_spans for r in chat.format_turns(empty).collect()][0] == []


def test_chat_query_has_no_python(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", None)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat.op9_chat_format(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExternalRDD", "Scan ExistingRDD"))
    assert out.dtypes == [("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint")]
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in out.collect()} == {1: (2, 0), -7: (2, len(chat.PLANTED))}
