"""Resampling, spelling variants and page extraction against plain Python."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import extract, resample, spelling
from tidemark.llm.kernels import crc32


def test_crc_of_many_spans():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 400)
    ends = starts + np.r_[rng.integers(0, 70, 380), rng.integers(60, 900, 20)]
    before = rng.integers(0, 1 << 32, 400).astype(np.uint32)
    assert crc32(data, starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]
    assert crc32(data, starts, ends, before).tolist() == [zlib.crc32(data[a:b], int(c)) for a, b, c in zip(starts, ends, before)]


def low(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_plain_python(spark, longest):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "gämma", "δelta", "x9", "don't", "long" * 40, "a b", "Ünder"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(300)] + [(7, "beta " * 30), (7, "beta " * 30), (None, "beta " * 25), (900, None), (901, ""), (902, text(20_000)), (903, " .-_ ")]
    target = [(1, "beta beta x9"), (2, None), (3, "δelta " * 50)]
    size = 97
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit("own"), "score": F.lit(1), "Text2": F.lit(2)}).repartition(5)
    got = resample.resample(df, spark.createDataFrame(target, "item_id long, text string"), percent=10, longest=longest, size=size)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    bucket = lambda f: zlib.crc32(f.encode()) % size
    s, t = (Counter(bucket(f) for _, x in rows for f in features(x, longest)[1]) for rows in (docs, target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + size) / ((s[b] + 1) * (t.total() + size)))) for b in range(size)]
    want = []
    for i, x in docs:
        n, own = features(x, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        want.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    drawn = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0] or 0, -w[1]))[: 10 * sum(w[4] for w in want) // 100]
    rank = Counter()
    expected = sorted(((*w[:4], drawn.index(w) + 1 if w in drawn else None) for w in want), key=repr)
    for w in drawn:
        rank[w] += 1
    found = got.collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(drawn) + 1))
    if max(rank.values()) == 1:
        assert sorted((tuple(r) for r in found), key=repr) == expected
    assert sorted(tuple(r)[:4] for r in found if r["doc_id"] is not None) == sorted(w[:4] for w in want if w[0] is not None)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (2, "b " * 40)], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    assert [tuple(r)[0:2] for r in resample.resample(some, none, percent=50).where("rank = 1").collect()] in ([(1, 30)], [(2, 40)])
    assert resample.resample(some, none).where("rank is not null").count() == 0


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def planted_words(docs, every):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w if h % every else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return count


@pytest.mark.parametrize("block", [4096, 5])
def test_spelling_equals_all_pairs(spark, block):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeéüñ") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["x" * 3000, "verylong" * 40, "Straße", "naïveté", "x×÷yyyyy"]
    pool = list(base)
    for w in base:
        for _ in range(4):
            k = rng.randrange(len(w))
            pool.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abzç") + w[k:], w[:k] + rng.choice("abzç") + w[k + 1 :]]))
    weight = [rng.choice([1, 1, 2, 8, 40]) for _ in pool]
    docs = [(i, " ".join(rng.choices(pool, weight, k=60)) + rng.choice(["", "; Straße-STRASSE ÀÉ Æ漢字naïveté"])) for i in range(120)]
    docs += [(3, docs[3][1]), (None, docs[4][1]), (200, None), (201, ""), (202, " 12 .")]
    every = 7
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(3)})
    got = {r["word"]: tuple(r) for r in spelling.group_variants(df, every=every, block=block).collect()}
    count = {w: n for w, n in planted_words(docs, every).items() if n >= 5 and len(w) >= 6}
    want, form_of = {}, {}
    for w, n in count.items():
        others = sorted((-m, o) for o, m in count.items() if near(w, o))
        form = others[0][1] if others and -others[0][0] >= 5 * n else None
        form_of[w] = form
        want[w] = (form, n, len(others), count[form] if form else None)
    for w, (form, n, many, form_n) in want.items():
        root = w
        while form_of[root]:
            root = form_of[root]
        assert got[w] == (w, form, root, n, many, form_n)
    assert set(got) == set(want) and sum(f is not None for f in form_of.values()) > 20


def test_masks_of_near_words_differ_by_two_letters_and_share_a_key():
    rng = random.Random(2)
    part = spelling.dealt({c: i for i, c in enumerate("etaoinshr")})
    for _ in range(300):
        a = "".join(rng.choice("abcdefghijé") for _ in range(8))
        k = rng.randrange(8)
        for b in (a[:k] + a[k + 1 :], a[:k] + "z" + a[k:], a[:k] + "ü" + a[k + 1 :]):
            raw = [a.encode("latin-1"), b.encode("latin-1")]
            m = spelling.masks(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(a), len(a) + len(b)]))
            same = [(m[0] == m[1])[part == p].all() for p in range(spelling.PARTS)]
            assert (m[0] != m[1]).sum() <= 2 and any(all(same[p] for p in key) for key in spelling.KEYS)


def test_spelling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(none).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, None), (2, "rare words only")], "doc_id long, text string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>if (a<b) document.write("<p>no</p>");</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies.</div><main><div id="main-sidebar">Links</div>
<article><header><h2>Title &amp; more&am</h2><p>By A. Writer</p></header><p class=lead><b>First <i>para</i>&nbsp;graph
 goes   on.<br>here<p>Second &copy; &#8364; &lt;b&gt; one.<ul><li>one<li>two</ul><span class="share">Share!</span>
<table><tr><td>a</td><td>b</td></tr></table><form><p>Your mail</p><input name=x></form><aside>Aside</aside><div hidden>H</div>
<figure><img src="a>b.png" alt='x'><figcaption>Caption</figcaption></figure><script>x</script></div> stray<p>End.</p>
<section class="reader comments"><article class="comment"><p>First!</p></article></section></article></main>
<p>Outside</p><footer>&copy; 2024</footer></body></html>"""


def plain(rows, spark, **extra):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return extract.extract(df, **extra)


def test_markup_of_a_page():
    found = extract.blocks(PAGE)
    inside = extract.zones(found)
    text = [b[0] for b, own in zip(found, inside) if own and not b[2]]
    assert text == ["Title & more&am", "First para graph goes on. here", "Second © € <b> one.", "one", "two", "a b", "Caption", "stray", "End."]


@pytest.mark.parametrize(
    "page",
    ["", "<", "<p", "a < b and c > d", "<p>" * 3000 + "x" + "</div>" * 3000, "<script>never closed <p>x", "<a href='unclosed><p>text</p>", "<p title=\"a>b\">t</p>", "<!-- open", "&#0;&#x110000;&bogus;", "<td>cell<td>other", "</p></article>x"],
)
def test_broken_pages_do_not_crash(page):
    assert all(isinstance(b[0], str) and b[0] for b in extract.blocks(page))


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 400):
        t = rng.integers(0, 4, n)
        order, common = extract.suffix_array(t, 8)
        own = [tuple(t[i : i + 8]) for i in range(n)]
        assert [own[i] for i in order] == sorted(own) and sorted(order) == list(range(n))
        for k in range(1, n):
            a, b = own[order[k - 1]], own[order[k]]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_supports_equal_counting():
    rng = np.random.default_rng(8)
    streams = [rng.integers(0, 3, rng.integers(1, 40)).astype(np.uint64) for _ in range(30)]
    holds = lambda s, gram: any(tuple(s[i : i + 4]) == gram for i in range(len(s) - 3))
    for s, got in zip(streams, extract.supports(streams)):
        grams = [sum(holds(o, tuple(s[i : i + 4])) for o in streams) for i in range(len(s) - 3)]
        assert got.tolist() == [max([1, *grams[max(0, k - 3) : k + 1]]) for k in range(len(s))]


def site(rng, n, host, notice=True):
    """Pages without telling markup: a template around own prose; (rows, own texts)."""
    rows, own = [], []
    for i in range(n):
        prose = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(6, 60))) for _ in range(rng.randrange(2, 6))]
        body = "".join(f"<p>{p}</p>" for p in prose)
        extra = "<div>Subscribe to our weekly letter today</div>" if notice else ""
        rows.append((i, f"https://{host}/a/{i}", f"<body><div><div>Home</div><div>World news</div><div>Sport and weather</div></div>{body}{extra}<div>All rights reserved by the {host} company</div></body>"))
        own.append("\n".join(prose))
    return rows, own


@pytest.mark.parametrize("limits", [{}, {"broadcast_blocks": 0}])
def test_templates_go_and_articles_stay(spark, monkeypatch, limits):
    monkeypatch.setattr(extract, "BLOCK_PAGES", 40)
    rng = random.Random(1)
    rows, own = site(rng, 130, "big.example")
    small, own_small = site(rng, 5, "Small.Example:80")
    lone, own_lone = site(rng, 1, "lone.example")
    rows += [(1000 + i, u, h) for i, u, h in small]
    rows += [(2000, rows[3][1], rows[3][2])] * 60  # copies of one page are one page
    rows += [(3000, None, rows[0][2]), (3001, "no host", rows[1][2]), (3002, "https://big.example/x", None), (3003, "https://big.example/y", "")]
    rows += [(4000, lone[0][1], lone[0][2])]
    out = {}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"Text": F.lit("mine"), "tag": F.concat(F.lit("t"), "page_id"), "_keys": F.lit(1)})
    got = extract.extract(df, **limits)
    assert got.columns == ["page_id", "url", "html", "tag", "text", "n_chars", "n_template"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["tag"] == f"t{r['page_id']}" and r["n_chars"] == len(r["text"])
        out.setdefault(r["page_id"], set()).add(r["text"])
    assert all(out[i] == {t} for i, t in enumerate(own))
    assert all(out[1000 + i] == {t} for i, t in enumerate(own_small))
    assert out[2000] == {own[3]} and out[3002] == out[3003] == {""}
    for i, t in ((3000, own[0]), (3001, own[1]), (4000, own_lone[0])):
        (text,) = out[i]
        assert text.startswith("Home\nWorld news") and t in text  # nothing to compare with


def test_a_line_that_many_articles_share_stays(spark):
    rng = random.Random(6)
    line = "This very line stands in many of the articles"
    page = lambda i: (i, f"http://h.example/{i}", "<nav>Menu of the site</nav><article><h1>T" + str(i) + "</h1>" + (f"<p>{line}</p>" if i % 3 == 0 else "") + "<p>" + " ".join(str(rng.random()) for _ in range(40)) + "</p><p>Follow the editors of h.example now</p></article>")
    got = {r["page_id"]: r["text"] for r in plain([page(i) for i in range(60)], spark).collect()}
    assert all((line in t) == (i % 3 == 0) for i, t in got.items())
    assert all("Follow the editors" not in t and t.startswith("T") for t in got.values())


def test_no_pages(spark):
    assert plain([], spark).count() == 0
    assert [tuple(r)[3:] for r in plain([(1, None, None)], spark).collect()] == [("", 0, 0)]
