"""Records and line numbers of text files are the same however the files are cut into splits."""

import csv
import io
import os
import random

import pytest

from tidemark.sources import lines, reviews, tweets


@pytest.fixture
def splits(spark):
    """Cut files into splits of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def cut(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], 0)

    yield cut
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def written(path, rows, header=("id", "text", "n")):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerows([header, *rows])
    path.write_bytes(out.getvalue().encode())
    return len(out.getvalue().encode())


def awkward(rng, n):
    parts = ["plain", 'a "quoted" word', "two\nlines", "\n\n", '""', '"', ",", "é", "x" * 50, "", 'ends with "', "\n\"\n"]
    return [(str(i), " ".join(rng.choices(parts, k=rng.randrange(1, 6))), str(rng.randrange(9))) for i in range(n)]


@pytest.mark.parametrize("size", [60, 10**7])
def test_same_rows_as_the_multi_line_reader(spark, tmp_path, splits, size):
    rows = awkward(random.Random(3), 30)
    long = written(tmp_path / "a.csv", rows)
    want = spark.read.csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"').collect()
    splits(size)
    got = lines.read_table(spark, str(tmp_path))
    assert size > long or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > long // size // 2
    found = sorted((r["_pos"], r["id"], r["text"], r["n"]) for r in got.collect())
    assert found == [(i + 1, r["id"], r["text"], r["n"]) for i, r in enumerate(want)]
    assert [f[2] or "" for f in found] == [r[1] for r in rows]


@pytest.mark.parametrize("at", range(0, 8, 2))
def test_an_escaped_quote_on_a_border(spark, tmp_path, splits, at):
    """The same file with its border moved byte by byte over an escaped quote and a quoted line break."""
    head = "id,text\n" + "p" * at + ',"b"\n'
    (tmp_path / "a.csv").write_text(head + '1,"say ""so""\n""now"""\n2,plain\n3,"a\n\nb"\n')
    splits(26)
    got = lines.read_table(spark, str(tmp_path / "a.csv"))
    assert sorted((r["_pos"], r["id"], r["text"]) for r in got.collect())[1:] == [(2, "1", 'say "so"\n"now"'), (3, "2", "plain"), (4, "3", "a\n\nb")]


@pytest.mark.parametrize("size", [90])
def test_numbers_run_through_many_files(spark, tmp_path, splits, size):
    rng = random.Random(8)
    want, at = [], 0
    for name in ("b.csv", "a.csv", "c.csv"):
        rows = awkward(rng, 6)
        written(tmp_path / name, rows)
    for name in sorted(os.listdir(tmp_path)):
        own = list(csv.reader(io.StringIO((tmp_path / name).read_text())))[1:]
        want += [(at + k + 1, r[0], r[1] or None) for k, r in enumerate(own)]
        at += len(own)
    splits(size)
    assert sorted((r["_pos"], r["id"], r["text"]) for r in lines.read_table(spark, str(tmp_path)).collect()) == want
    plain = [t for name in sorted(os.listdir(tmp_path)) for t in (tmp_path / name).read_text().split("\n")[:-1]]
    got = sorted((r["line"], r["value"]) for r in lines.numbered_lines(spark, str(tmp_path)).collect())
    assert got == [(i + 1, t) for i, t in enumerate(plain)]


def test_tweets_keep_their_physical_lines(spark, tmp_path, splits):
    text = '"0","1","d","q","u","café ""x"""\n\n"4","2","short"\r\n"0","3","d","q","u","t","more","most"\n'
    (tmp_path / "t.csv").write_bytes(text.encode("latin-1"))
    splits(16)
    got = sorted((r["line"], r["fields"], r["id"], r["text"]) for r in tweets.read_tweets(spark, str(tmp_path / "t.csv")).collect())
    assert got == [(1, 6, "1", 'café "x"'), (3, 3, "2", None), (4, 7, "3", "t")]


def test_split_files_and_an_open_quote(spark, tmp_path, splits):
    for name in ("train", "val", "test"):
        written(tmp_path / f"{name}.csv", [("1", f"of {name}\nline", "2")])
    assert {(r["split"], r["text"]) for r in tweets.read_splits(spark, str(tmp_path)).collect()} == {(n, f"of {n}\nline") for n in ("train", "val", "test")}
    (tmp_path / "open.csv").write_text('id,text\n1,"never closed\n2,x\n3,y\n')
    splits(8)
    assert [(r["_pos"], r["id"]) for r in lines.read_table(spark, str(tmp_path / "open.csv")).collect()] == [(1, "1")]


def test_blank_ids_are_no_common_key(spark, tmp_path):
    written(tmp_path / "r.csv", [("", "t1"), ("a", "t2"), ("", "t3"), ("a", "t4"), ("b c", "t5")], ("id", "review"))
    got = reviews.read_csv(spark, str(tmp_path / "r.csv"))
    assert [r["review_id"] for r in got.orderBy("_pos").collect()] == ["U000001", "a", "U000003", "U000004", "U000005"]


def test_no_rows(spark, tmp_path):
    for name, text in (("empty.csv", ""), ("blank.csv", "\n\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            lines.read_table(spark, str(tmp_path / name))
    (tmp_path / "header.csv").write_text("text\n")
    with pytest.raises(ValueError):
        reviews.read_csv(spark, str(tmp_path / "header.csv"))


def test_quoted_empty_fields_are_texts(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"0","1","d","q","u",""\n"4","2","","q","u",""\n"4","3","short"\n"4","4",,"q","u","t"\n')
    got = sorted((r["line"], r["fields"], r["date"], r["text"]) for r in tweets.read_tweets(spark, str(tmp_path / "t.csv")).collect())
    assert got == [(1, 6, "d", ""), (2, 6, "", ""), (3, 3, "short", None), (4, 5, None, "t")]


def odd_documents(spark, folder, odd, n=70):
    """n documents that are one of the odd texts each, in turn."""
    from pyspark.sql import functions as F

    texts = F.array(*[F.lit(t) for t in odd])
    columns = [(F.col("id") % len(odd)).cast("int"), F.lit("en").alias("lang"), F.lit("s1").alias("source")]
    spark.range(0, n, 1, 3).select(F.col("id").alias("doc_id"), texts[columns[0]].alias("text"), *columns[1:]).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["tweets_profile", "tweets_scan"])
def test_tweets_without_text_match_sql(spark, tmp_path, name):
    same_as_sql(spark, name, odd_documents(spark, tmp_path, [None, "", " ", 'a "b"', "\r", "\n", ","]))


def same_as_sql(spark, name, folder):
    import duckdb

    from tidemark.plans import catalogue

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    got = catalogue.QUERIES[name](spark, folder)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_split_files_without_text_match_sql(spark, tmp_path):
    same_as_sql(spark, "split_files", odd_documents(spark, tmp_path, [None, "", " ", 'a "b"', "a\r", "\n", "\r\n"], 14))
