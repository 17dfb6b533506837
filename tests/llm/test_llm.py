"""The operators for training data against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidemark.llm.toxicity as tox
from tidemark.llm import chat, containment, induced, jaccard, kernels, mixing, shards, urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def prose(rng, n):
    return " ".join(rng.choice("alpha Beta gamma delta eps Zeta eta theta iota kappa lam mu".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(30)]
    passage = prose(rng, 60)
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(30, 60):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
        out.append((i, " ".join(w)))
    out += [(100 + i, prose(rng, 10) + " " + passage + "\n" + prose(rng, 15)) for i in range(6)]
    out += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "One  two"), (205, "é" * 150), (206, "x" + "é" * 150), (207, base[0]), (208, "aaaa" * 60), (None, "no id here at all, none")]
    return out


@pytest.fixture(scope="module")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"))
    return df.withColumns({"n_chars": F.length("text"), "Shard": F.lit(1), "score": F.lit("x"), "kept": F.lit(0)}).repartition(5)


def empty(docs):
    return docs.where("false")


def test_word_kernel_matches_regex(corpus):
    for _, text in corpus:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        s, e, _ = kernels.words(raw, np.array([0, len(raw)]))
        assert [raw[a:b].tobytes().decode().translate(LOWER) for a, b in zip(s, e)] == words(text)


def test_shingle_hashes_stand_for_shingles(corpus):
    seen = {}
    for _, text in corpus:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        row, h = kernels.shingles(raw, np.array([0, len(raw)]))
        assert len(set(h.tolist())) == len(shingle_set(text))
        for k, q in zip(h.tolist(), [tuple(words(text)[i : i + 5]) for i in range(len(h))]):
            assert seen.setdefault(k, q) == q


@pytest.mark.parametrize("spill", [{}, {"budget": 64, "base": 2}])
def test_induced_sorting(spill):
    rng = np.random.default_rng(1)
    for trial in range(60):
        t = np.append(rng.integers(1, (2, 3, 6, 30)[trial % 4], rng.integers(1, 70)), 0)
        got = list(induced.suffixes(t, **spill))
        pos, lcp = (np.concatenate(x) for x in zip(*got))
        tails = [tuple(t[i:]) for i in range(len(t))]
        assert pos[::-1].tolist() == sorted(range(len(t)), key=lambda i: tails[i])
        for k in range(1, len(t)):
            a, b = tails[pos[k]], tails[pos[k - 1]]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def components(corpus):
    sets = [(k, shingle_set(t)) for k, t in corpus if k is not None]
    up = {k: k for k, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, q in sets[:i]:
            if s and q and 100 * len(s & q) >= 75 * len(s | q):
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    return {k: (len(s), find(k)) for k, s in sets}


@pytest.mark.parametrize("short", [8, 2])
def test_jaccard_join(docs, corpus, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs.where("doc_id is not null")).collect()}
    assert got == components(corpus)


@pytest.mark.parametrize("most", [0, 1000])
def test_components(spark, monkeypatch, most):
    import tidemark.llm.components as cc

    monkeypatch.setattr(cc, "ONE_TASK_EDGES", most)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.comp for r in cc.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        up[hi] = lo
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_jaccard_edges(docs):
    assert jaccard.link(empty(docs)).count() == 0
    assert jaccard.link(docs.where("doc_id is null or doc_id = 200")).count() == 2
    twice = jaccard.link(docs.where("doc_id = 1").union(docs.where("doc_id = 1"))).collect()
    assert [(r.doc_id, r.component_id) for r in twice] == [(1, 1), (1, 1)]


def test_containment(spark, corpus, docs):
    items = [(1, corpus[3][1]), (2, " ".join(corpus[5][1].split()[2:18])), (3, None), (4, ""), (5, "one two"), (6, prose(random.Random(9), 30))]
    got = {(r.doc_id, x.item_id) for r in containment.leaks(docs.where("doc_id is not null"), spark.createDataFrame(items, "item_id long, text string")).collect() for x in r.leaks}
    want = set()
    for k, t in corpus:
        for i, q in items:
            s, w = shingle_set(q), words(q)
            if k is None or not w:
                continue
            runs = {tuple(words(t)[a : a + len(w)]) for a in range(len(words(t)) - len(w) + 1)} if len(w) < 5 else shingle_set(t)
            if 100 * len(s & runs) >= 75 * len(s):
                want.add((k, i))
    assert got == want and len(got) > 3
    assert containment.decontaminate(empty(docs), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert containment.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(corpus)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60) + (" vile nasty vilest" if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(600)] + [(700, None, 0), (701, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = tox.score(df.select("doc_id", "text", F.lit(1).alias("Score")), tox.fit_model(df.select("doc_id", "text"), df.select("doc_id", "toxic")))
    got = {r.doc_id: r.score for r in out.collect()}
    held = [r.doc_id for r in df.where(tox.held_out(F.col("doc_id"))).collect()]
    truth = {i: y for i, _, y in rows}
    assert len(held) > 60 and all((got[i] >= 0.5) == (truth[i] == 1) for i in held if truth[i] is not None)
    assert 0 <= got[700] == got[701] < 0.5
    bare = tox.fit_model(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("toxic = 0"))
    assert {r.score >= 0.5 for r in tox.score(df.select("doc_id", "text"), bare).collect()} == {False}


def test_shards_are_even_uniform_and_repeatable(docs, corpus):
    many = docs.drop("Shard").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20))))
    a = shards.shuffle_into_shards(many, 7, block=16)
    rows = a.select("doc_id", "k", "shard", "slot").collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == 20 * len(corpus) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert shards.shuffle_into_shards(empty(docs), 7).count() == 0


def test_communication_matrix():
    counts, cells = np.array([5, 0, 17, 9]), np.array([10, 11, 10])
    m = np.array([shards.matrix_row(i, counts, cells, 3) for i in range(4)])
    assert (m.sum(1) == counts).all() and (m.sum(0) == cells).all()
    rng = np.random.default_rng(0)
    draws = [shards._hypergeometric_large(rng, 30, 70, 40) for _ in range(4000)]
    assert abs(np.mean(draws) - 12) < 0.2 and abs(np.var(draws) - 40 * 0.3 * 0.7 * 60 / 99) < 0.5


def test_mixing_meets_targets(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 20).cast("int")).alias("text"), F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 7 == 0, None).otherwise("big").alias("source"), F.lit(9).alias("Copy"))
    out = mixing.mix(df).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    assert len(out) == 3 and max(r.n for r in out) < 1.25 * min(r.n for r in out)
    weighted = mixing.mix(df, {"small": 1.0}).select("source").distinct().collect()
    assert [r.source for r in weighted] == ["small"]
    assert mixing.mix(df.where("false")).count() == 0
    a, b = (sorted(map(tuple, mixing.mix(df.repartition(n)).select("doc_id", "n_copies", "copy", "shuffle_key").collect())) for n in (2, 9))
    assert a == b


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "back\\slash \\\\ [INST", "<<SYS>> x <</SYS>>", "a\nb <s>", "", None, "<", "[", "\\", "<</ROLE>>"]
    rows = [(1, k, ("user", "assistant", "system", "tool", None)[k % 5], t) for k, t in enumerate(nasty * 2)] + [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("n_turns", F.lit(1))
    done = chat.format_turns(chat.canonical_table(df)).select("conv_id", "turns", chat.parse_turns(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in done.collect():
        assert [tuple(t) for t in r.back] == [tuple(t) for t in r.turns]
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
    assert chat.canonical_table(df.where("false")).count() == 0


def test_chat_layouts_by_fingerprint(spark):
    raws = ['{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}', '{"prompt":"a","response":"b"}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', '{"instruction":"a","input":"","output":"b"}', '{"what":1}', "not json", None]
    got = chat.canonical_json(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string"), "raw", ("i",)).orderBy("i").collect()
    assert [r.layout for r in got] == ["messages", "prompt", "from and value", "instruction and input", None, None, None]
    assert all([(t.role, t.text) for t in r.turns] == [("user", "a"), ("assistant", "b")] for r in got[:4]) and got[4].turns is None
    table = chat.canonical_table(spark.createDataFrame([("a", "b")], "prompt string, completion string"))
    assert [tuple(t) for t in table.first().turns] == [("user", "a"), ("assistant", "b")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_table(spark.createDataFrame([(1,)], "what int"))


def test_url_rules(spark):
    cases = {
        "http://A.Example.com/en/7?x=1": ("example.com/en/7", "allow"), "https://example.com/en/71": ("example.com/en/7", "allow"), "http://x.com/en/1": ("com/en/", "block"), "http://q.net/de/8": ("net/de/", "allow"),
        "http://m.example.net/de/88#t": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block"), "http://badexample.com/en/7": ("com/en/", "block"), "no scheme": (None, "allow"), None: (None, "allow"), "": (None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(cases)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"Host": F.lit("x"), "confidence": F.lit("y"), "probe": F.lit(1)})
    none = pages.limit(0).withColumn("bad", F.lit(True))
    out = urls.judge(pages, none)
    got = out.select("url", "rule", "verdict", "probe", "confidence").collect()
    assert len(got) == 2 * len(cases) and {r.url: (r.rule, r.verdict) for r in got} == cases and {(r.probe, r.confidence) for r in got} == {(1, None)}
    assert urls.judge(pages.limit(0), none).count() == 0


def test_url_rules_need_enough_labelled_urls(spark):
    rows = [(f"http://a.info/x/{i}", False) for i in range(60)] + [(f"http://b.info/win/{i}", True) for i in range(4)] + [(None, True)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    assert urls.mine(df, urls.Mining(support=0.001)).count() == 0
    assert urls.mine(df, urls.Mining(support=0.001, least=4)).count() > 0


def test_url_miner_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, f"http://{rng.choice('abc')}.site.info/{rng.choice(['win', 'news', 'shop'])}/{rng.choice(['cash', 'day'])}/{i}", None) for i in range(400)]
    rows = [(i, u, "/win/cash/" in u) for i, u, _ in rows]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    mined = urls.mine(df).collect()
    rules = [(set(r["items"]), r["confidence"]) for r in mined]
    assert any({"path=win", "path=cash"} == need for need, _ in rules)
    have = {r.url: set(r.t) for r in df.select("url", urls.items(F.col("url")).alias("t")).collect()}
    times = collections.Counter(t for own in have.values() for t in own)
    assert all(r.probe == min(r["items"], key=lambda t: (times[t], t)) for r in mined)
    # every frequent, confident antecedent is a rule or says no more than a shorter one
    held = [(have[u], bad) for _, u, bad in rows]
    for need, confidence in rules:
        n = sum(need <= t for t, _ in held)
        assert confidence == sum(need <= t and b for t, b in held) / n
    tokens = sorted(times)
    for a in tokens:
        for b in tokens:
            need = {a, b}
            both = sum(need <= t and bad for t, bad in held)
            n = sum(need <= t for t, _ in held)
            if both >= max(5, 0.002 * 400) and both / n >= 0.6 and both / n >= 1.5 * sum(bad for _, bad in held) / 400:
                assert any(own <= need and c >= both / n for own, c in rules)
    got = {r.url: r.verdict for r in urls.judge(df.select("page_id", "url"), df).collect()}
    assert got == {u: "block" if any(need <= t for need, _ in rules) else "allow" for u, t in have.items()}
    assert sum(v == "block" for v in got.values()) == sum(b for *_, b in rows)
