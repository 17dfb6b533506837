"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

The mask of a word has a bit for each letter: whether it has that letter an odd number of times. One inserted or deleted code
point flips one bit, one replaced flips two, so masks of near words differ in at most two bits. The letters are dealt, by how many words have them, over
three bands; near words have at least one band alike. What is left outside that band differs by two bits at most again and is cut into three the
same way, so near words share at least one of nine keys, each of five of the mask's nine parts. Words meet by key; what meets is compared by length (one apart at most), by
the whole mask (two bits at most) and then letter by letter. A pair that shares several keys is reported under the first alone.

The words of a key are held in one task only up to `BLOCK`; a key with more is cut into blocks by word, and its pairs of blocks are dealt over tasks. Only near
pairs leave a task.

Words are counted in tasks by batch and summed by Spark; what travels is the vocabulary, not the texts.

Defined results: a null or empty text has no words; a null id counts as an empty one in the hash that plants variants; rows that repeat an id or a text count each;
a run of any length is one word, compared whole; of near words with the same count the smaller in code-point order is the form; an empty table, or one without frequent words, gives an
empty result; extra columns go.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Stored, chunks, keep_columns, partitions, small_batches, thrifty
from tidemark.llm.kernels import crc32, runs

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
EVERY = 199
BLOCK = 4096
PARTS = 9
PAIRS_AT_ONCE = 1 << 20
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
BROADCAST_KEYS = 200_000


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF, and the data with A-Z lower-cased."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    data = low[data]
    lead = data == 0xC3  # the first byte of U+00C0 to U+00FF and of nothing else
    solid = ((data >= 97) & (data <= 122)) | lead
    solid[1:] |= lead[:-1]
    return *runs(solid, offsets), data


def counted(docs: DataFrame, every: int = EVERY, length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over all texts, words of under `length` code points left out; of every `every`-th (document, word) one letter is deleted first."""

    def count(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row0, data, offsets in chunks(batch, "text"):
                starts, ends, row, data = letter_runs(data, offsets)
                n = len(starts)
                if not n:
                    continue
                own = [f"{'' if i is None else i}:".encode() for i in ids[row0 : row0 + len(offsets) - 1]]
                before = np.array([zlib.crc32(x) for x in own], np.uint32)[row]
                hashes = crc32(data, starts, ends, before)
                solid = np.zeros(len(data) + 1, np.int64)
                np.cumsum(data == 0xC3, out=solid[1:])
                points = (ends - starts) - (solid[ends] - solid[starts])
                cut = hashes % np.uint32(every) == 0
                whole = ~cut & (points >= length)
                changed = []
                for a, b, h in zip(starts[cut], ends[cut], hashes[cut]):
                    word = bytes(data[a:b]).decode()
                    at = int(h) % len(word)
                    if len(word) > length:
                        changed.append(word[:at] + word[at + 1 :])
                sizes = (ends - starts)[whole]
                ahead = np.cumsum(sizes) - sizes
                text = data[np.repeat(starts[whole] - ahead, sizes) + np.arange(sizes.sum())]
                words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.append(ahead, sizes.sum())), pa.py_buffer(text))
                found = pa.chunked_array([words, pa.array(changed, pa.large_string())]).value_counts()
                found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])

    return keep_columns(docs, "doc_id", "text").mapInArrow(thrifty(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def masks(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(words, letters) parity of every letter; codes: the words' code points, one byte each."""
    out = np.zeros((len(offsets) - 1, len(LETTERS)), bool)
    place = np.full(256, -1)
    place[LETTERS] = np.arange(len(LETTERS))
    flat = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * len(LETTERS) + place[codes]
    out.ravel()[:] = np.bincount(flat, minlength=out.size) & 1
    return out


def dealt(letters: dict[str, int]) -> np.ndarray:
    """The part (0 to 8) of each letter, so that parts have letters of like frequency: the most frequent are dealt forth and back."""
    order = sorted(range(len(LETTERS)), key=lambda i: (-letters.get(chr(LETTERS[i]), 0), i))
    forth = [*range(PARTS), *reversed(range(PARTS))]
    out = np.zeros(len(LETTERS), np.int64)
    for k, i in enumerate(order):
        out[i] = forth[k % len(forth)]
    return out


def _keys() -> list[list[int]]:
    """The parts of each of the nine keys: a band of three, and one part of each other band. Band i has the parts i, i + 3 and i + 6."""
    bands = [[i, i + 3, i + 6] for i in range(3)]
    return [[*bands[i], bands[(i + 1) % 3][j], bands[(i + 2) % 3][j]] for i in range(3) for j in range(3)]


KEYS = _keys()
#: What a key leaves open: four parts with two flips at most, so one of these three is alike again. Tasks sort by it inside a key.
REST = [[[a], [b], [c, d]] for a, b, c, d in ([p for p in range(PARTS) if p not in key] for key in KEYS)]


def near(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether rows of code points (padded by 0) are one edit apart; size_b is size_a or one more."""
    out = np.zeros(len(a), bool)
    same = size_a == size_b
    out[same] = (a[same] != b[same]).sum(1) == 1
    other = np.flatnonzero(~same)
    if len(other):
        x, y, n = a[other], b[other], size_a[other]
        inside = np.arange(x.shape[1] - 1)[None] < n[:, None]
        ahead = np.cumprod((x[:, :-1] == y[:, :-1]) | ~inside, axis=1) * inside
        behind = ((x[:, :-1] == y[:, 1:]) | ~inside)[:, ::-1]
        behind = np.cumprod(behind, axis=1)[:, ::-1] * inside
        out[other] = ahead.sum(1) + behind.sum(1) >= n
    return out


class _Group:
    """Words that met under keys, and their near pairs."""

    def __init__(self, table: pa.RecordBatch):
        self.words = table.column("word")
        flat = [w.encode("latin-1") for w in self.words.to_pylist()]
        self.size = np.array([len(w) for w in flat])
        self.offsets = np.append(0, np.cumsum(self.size))
        self.codes = np.frombuffer(b"".join(flat), np.uint8)
        packed = np.packbits(masks(self.codes, self.offsets), axis=1)
        wide = np.zeros((len(flat), -(-packed.shape[1] // 8) * 8), np.uint8)
        wide[:, : packed.shape[1]] = packed
        self.mask = [np.ascontiguousarray(m) for m in wide.view(np.uint64).T]
        # one edit leaves as many letters alike at one end as half the shortest word has; up to three are compared before whole words are
        k = min(3, int(self.size.min()) // 2) if len(flat) else 0
        ahead, behind = np.zeros(len(flat), np.int32), np.zeros(len(flat), np.int32)
        for i in range(k):
            ahead = ahead << 8 | self.codes[self.offsets[:-1] + i]
            behind = behind << 8 | self.codes[self.offsets[1:] - 1 - i]
        self.ends = ahead.astype(np.int32), behind.astype(np.int32)
        self.parts = np.stack([table.column(f"p{i}").to_numpy() for i in range(PARTS)])
        self.n = table.column("n").to_numpy()

    def padded(self, at: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(at), width), np.uint8)
        size = self.size[at]
        row = np.repeat(np.arange(len(at)), size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[row, within] = self.codes[np.repeat(self.offsets[at], size) + within]
        return out

    def found(self, x: np.ndarray, y: np.ndarray, key: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the candidates (x, y), one apart in length at most, the near ones whose first common key is `key` and its first common rest `rest`."""
        flips = sum(np.bitwise_count(m[x] ^ m[y]) for m in self.mask)
        ok = flips <= 2
        x, y = x[ok], y[ok]
        ok = np.logical_or(*(e[x] == e[y] for e in self.ends))
        x, y = x[ok], y[ok]
        swap = self.size[x] > self.size[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        alike = self.parts[:, x] == self.parts[:, y]
        for earlier in [*KEYS[:key], *([*KEYS[key], *r] for r in REST[key][:rest])]:
            fresh = ~alike[earlier].all(0)
            x, y, alike = x[fresh], y[fresh], alike[:, fresh]
        keep = [np.zeros(0, np.int64)]
        order = np.argsort(self.size[y], kind="stable")
        k = 0
        while k < len(order):
            width = int(self.size[y[order[k]]])
            step = max(1, PAIRS_AT_ONCE * 8 // (width + 1))
            own = order[k : k + step]
            own = own[self.size[y[own]] <= 2 * width]  # sorted: no word is padded to more than twice its length
            width = int(self.size[y[own]].max())
            keep.append(own[near(self.padded(x[own], width + 1), self.padded(y[own], width + 1), self.size[x[own]], self.size[y[own]])])
            k += len(own)
        own = np.concatenate(keep)
        return x[own], y[own]


def _ahead(stop: np.ndarray):
    """Yield (x, y) for all rows x and y with x < y < stop[x], about PAIRS_AT_ONCE at once."""
    row = np.arange(len(stop), dtype=np.int32)
    after = stop - row - 1
    total = np.cumsum(after)
    k = 0
    while k < len(row):
        done = int(np.searchsorted(total, (total[k - 1] if k else 0) + PAIRS_AT_ONCE, "right"))
        own, many = row[k : max(k + 1, done)], after[k : max(k + 1, done)]
        x = np.repeat(own, many)
        first = np.repeat((own + 1 - (np.cumsum(many) - many)).astype(np.int32), many)
        yield x, first + np.arange(len(x), dtype=np.int32)
        k += len(own)


def _search(batches):
    """Near pairs of rows sorted by (key, hash, block_a, block_b); a group goes on into the next batch."""

    def pairs(table: pa.RecordBatch):
        group = _Group(table)
        cols = [table.column(c).to_numpy() for c in ("key", "hash", "block_a", "block_b")]
        met = np.cumsum(np.append(False, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])))  # rows come sorted
        block, a, b = (table.column(c).to_numpy() for c in ("block", "block_a", "block_b"))
        take = lambda v, i: v.take(pa.array(i))
        for key in np.unique(cols[0]):
            own = np.flatnonzero(cols[0] == key)
            for rest, parts in enumerate(REST[key]):
                alike = np.unique(group.parts[parts][:, own], axis=1, return_inverse=True)[1].ravel()
                order = own[np.lexsort((group.size[own], alike, met[own]))]
                run = met[own] * (int(alike.max()) + 1) + alike
                by_size = np.sort(run * (int(group.size[own].max()) + 3) + group.size[own])
                for x, y in _ahead(np.searchsorted(by_size, by_size + 1, "right")):
                    x, y = order[x], order[y]
                    if b[own].any():
                        new = (a[x] == b[x]) | (block[x] != block[y])  # a pair inside one of two blocks is that block's own
                        x, y = x[new], y[new]
                    x, y = group.found(x, y, key, rest)
                    if len(x):
                        yield pa.RecordBatch.from_arrays([take(group.words, np.append(x, y)), pa.array(np.append(group.n[x], group.n[y])), take(group.words, np.append(y, x)), pa.array(np.append(group.n[y], group.n[x]))], ["word", "n", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        same = np.logical_and.reduce([batch.column(c).to_numpy() == batch.column(c)[len(batch) - 1].as_py() for c in ("key", "hash", "block_a", "block_b")])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            held.append(batch.slice(0, cut))
            yield from pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n), both ways, of stored words(word, n)."""
    small_batches(words.sparkSession)
    letter = F.explode(F.array_distinct(F.split("word", "")))
    letters = {r["c"]: r["n"] for r in words.select(letter.alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a letter
    part = dealt(letters)

    def keyed(batches):
        rng = np.random.Generator(np.random.PCG64(13))
        value = rng.integers(1, 1 << 62, len(LETTERS)).astype(np.int64)
        for batch in batches:
            flat = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            if not flat:
                continue
            m = masks(np.frombuffer(b"".join(flat), np.uint8), np.append(0, np.cumsum([len(w) for w in flat])))
            # a part's value is the sum of its odd letters' values: equal for equal bits, and for others by a chance of 2**-62, which the whole mask then settles
            parts = np.stack([(m[:, part == p] * value[part == p]).sum(1) for p in range(PARTS)])
            for k, own in enumerate(KEYS):
                with np.errstate(over="ignore"):
                    h = sum(parts[p] * np.int64(2 * i + 3) for i, p in enumerate(own))
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(np.full(len(flat), k, np.int32)), pa.array(h), *[pa.array(x) for x in parts]], ["word", "n", "key", "hash", *[f"p{i}" for i in range(PARTS)]])

    fields = ", ".join(f"p{i} long" for i in range(PARTS))
    rows = words.select("word", "n").mapInArrow(keyed, f"word string, n long, key int, hash long, {fields}")
    heavy = Stored(rows.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > block)).read()
    few = F.broadcast(heavy) if heavy.count() <= BROADCAST_KEYS else heavy
    rows = rows.join(few, ["key", "hash"], "left")
    blocks = F.coalesce(F.ceil(F.col("many") / block), F.lit(1)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")}).drop("many", "other")
    group = ["key", "hash", "block_a", "block_b"]
    return rows.repartition(partitions(words), *group).sortWithinPartitions(*group).mapInArrow(thrifty(_search), "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following stored forms(word, form) to their ends, twice as far each round; a form's count is a multiple of its word's, so paths are short."""
    known = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = Stored(known.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        known = step.read().select("word", "root")
        if step.read().where("moved").isEmpty():
            return known


def variants(words: DataFrame, ratio: float = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of stored words(word, n)."""
    best = F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))
    found = Stored(near_pairs(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best"), F.first("n").alias("n"))).read()
    good = -F.col("best.n") >= ratio * F.col("n")
    found = found.select("word", "n_near", F.when(good, F.col("best.w")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n"))
    ends = roots(found.where("form is not null").select("word", "form"))
    out = words.join(found, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def group_variants(docs: DataFrame, least: int = LEAST_COUNT, length: int = LEAST_LENGTH, ratio: float = RATIO, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """The words of docs with at least `length` code points and `least` occurrences, each with its form, root and near words."""
    small_batches(docs.sparkSession)
    return variants(Stored(counted(docs, every, length).where(F.col("n") >= least)).read(), ratio, block)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    from tidemark.llm.resample import CRC_SQL, crc_sql

    key = "(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)"
    return f"""
WITH {CRC_SQL},
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
r AS (SELECT doc_id, w, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT w, n, {crc_sql(key)} AS h FROM r, crc_table),
c AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, unnest(range(length(word))) AS g(i)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM x a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM x a JOIN v b ON a.rest = b.word),
q AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min({{'n': -near_n, 'w': near}}) AS best FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= {RATIO} * v.n THEN best.w END AS form, CASE WHEN -best.n >= {RATIO} * v.n THEN -best.n END AS form_n FROM v LEFT JOIN q USING (word)),
t AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.up = f.word)
SELECT f.word, form, t.root, n, n_near, form_n FROM f JOIN t ON t.word = f.word AND t.up IS NULL"""


QUERIES = {"op13_spelling": op13_spelling}
ORACLES = {"op13_spelling": _oracle()}
