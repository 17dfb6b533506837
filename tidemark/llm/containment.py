"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by size: class c holds items of up to 2**c shingles. For each class a document is cut into
windows of 2**(c + 1) shingles, one every 2**c, so a passage of the class's length lies whole in one window and the
two sets are of like size, however long the document. Window and item signatures have `HASHES` minima; one equal
minimum makes a candidate (bands of one row). A window that holds a share s of an item of n shingles misses with
probability below (1 - s * n / (n + 2**(c + 1)))**HASHES, and the windows of a document that shares 75 % of an
item in scattered pieces have as many chances together. Candidates are verified by exact shingle
containment: 100 * |item and document| >= 75 * |item|, over sets of distinct five-word shingles. Items of up to five
words are one shingle; these are looked up exactly among the document's runs of as many words, without signatures.
Measured on passages of sf0.1 documents that were put whole into other documents, 1,500 of each length: of 5, 8, 13, 20, 60 and 200 words
none was missed, of 6 words one.
Items are few by nature; they are broadcast in blocks of `ITEM_BLOCK`, as plain arrays.

Defined results: a null or wordless item matches nothing; a null or wordless document is clean; repeated rows
are judged each; items with equal text all report, and so does an item without an id (as null); empty tables give
empty or clean results; extra columns travel along in `decontaminate`, but for one called leaks.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import chunks, small_batches, thrifty
from tidemark.llm.kernels import U, WIDTH, mix, prefix, shingles, span_hash, words

HASHES = 64
PERCENT = 75
ITEM_BLOCK = 20_000
LEAST_CLASS = 3
_FAMILY = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, (2, HASHES), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def folded(h: np.ndarray) -> np.ndarray:
    return (h >> U(32)).astype(np.uint32)


def minima(h: np.ndarray, step: int) -> np.ndarray:
    """(HASHES, blocks) of minima over consecutive blocks of `step` values; the last block is filled up with its last value."""
    blocks = -(-len(h) // step)
    full = np.empty(blocks * step, np.uint32)
    full[: len(h)] = h
    full[len(h) :] = h[-1]
    cols = np.ascontiguousarray(full.reshape(blocks, step).T)
    out = np.empty((HASHES, blocks), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            out[j] = (cols * _FAMILY[0, j] + _FAMILY[1, j]).min(axis=0)
    return out


class Items:
    """Shingle sets and signatures of a block of items, by size class; `few` holds items of up to WIDTH words: by length, items by shingle."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids, self.sets, self.few = [], [], {}
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            offsets = np.array([0, len(raw)], np.int64)
            n = len(words(raw, offsets)[0])
            if not n:
                continue
            own = np.unique(shingles(raw, offsets, min(n, WIDTH))[1])
            if n <= WIDTH:
                self.few.setdefault(n, {}).setdefault(int(own[0]), []).append(item)
            else:
                self.ids.append(item)
                self.sets.append(own)
        self.classes: dict[int, dict] = {}
        for i, own in enumerate(self.sets):
            c = max(LEAST_CLASS, int(np.ceil(np.log2(len(own)))))
            self.classes.setdefault(c, {"items": [], "sig": []})
            self.classes[c]["items"].append(i)
            self.classes[c]["sig"].append(minima(folded(own), len(own))[:, 0])
        for x in self.classes.values():
            sig, items = np.array(x.pop("sig")), np.array(x.pop("items"))
            keys = (np.arange(HASHES, dtype=np.uint64)[None, :] << U(32)) | sig.astype(np.uint64)
            flat = keys.ravel()
            order = np.argsort(flat, kind="stable")
            x["keys"], x["owner"] = flat[order], np.repeat(items, HASHES)[order]

    @property
    def plain(self) -> dict:
        """Lists, dicts and arrays only: what a broadcast value may hold where executors lack this package."""
        return dict(vars(self))

    @classmethod
    def of(cls, plain: dict) -> Items:
        out = cls([])
        vars(out).update(plain)
        return out

    def candidates(self, h: np.ndarray, row: np.ndarray, rows: int) -> set[tuple[int, int]]:
        """(row, item) pairs with an equal minimum in one of the row's windows; `h` in text order, rows ascending."""
        out: set[tuple[int, int]] = set()
        if not len(h) or not self.classes:
            return out
        base = 1 << min(self.classes)
        counts = np.bincount(row, minlength=rows)
        blocks = -(-counts // base)
        # one layout for all rows: each row is filled up to whole blocks with its own last value
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        to = np.concatenate(([0], np.cumsum(blocks * base)))
        place = np.arange(len(h)) - first[row] + to[:-1][row]
        full = np.zeros(int(to[-1]), np.uint32)
        full[place] = folded(h)
        filled = np.flatnonzero(counts > 0)
        pad = (blocks * base - counts)[filled]
        if pad.sum():
            at = np.repeat(to[1:][filled] - pad, pad) + (np.arange(pad.sum()) - np.repeat(np.cumsum(pad) - pad, pad))
            full[at] = np.repeat(full[to[1:][filled] - pad - 1], pad)
        level = minima(full, base)
        owner = np.repeat(np.arange(rows), blocks)
        for c in range(min(self.classes), max(self.classes) + 1):
            # level: minima of blocks of 2**c; a window is two neighbours of one row
            window = level.copy()
            same = owner[1:] == owner[:-1]
            window[:, :-1][:, same] = np.minimum(level[:, :-1][:, same], level[:, 1:][:, same])
            if c in self.classes:
                x = self.classes[c]
                for j in range(HASHES):
                    lo, hi = np.searchsorted(x["keys"], [j << 32, (j + 1) << 32])
                    own = (x["keys"][lo:hi] & U(0xFFFFFFFF)).astype(np.uint32)
                    at = np.searchsorted(own, window[j])
                    hit = np.flatnonzero((at < len(own)) & (own[np.minimum(at, len(own) - 1)] == window[j])) if len(own) else []
                    for w in hit:
                        k = at[w]
                        while k < len(own) and own[k] == window[j][w]:
                            out.add((int(owner[w]), int(x["owner"][lo + k])))
                            k += 1
            if c < max(self.classes):
                # next: blocks of 2**(c + 1), from each row's pairs of blocks
                pos = np.arange(len(owner)) - np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))[owner]
                even = np.flatnonzero(pos % 2 == 0)
                level, owner = window[:, even], owner[even]
        return out

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item id, shared, size) of every item contained in a row."""
        rows = len(offsets) - 1
        row, h = shingles(data, offsets)
        found = []
        for r, i in sorted(self.candidates(h, row, rows)):
            lo, hi = np.searchsorted(row, [r, r + 1])
            shared = int(np.isin(self.sets[i], h[lo:hi]).sum())
            if 100 * shared >= PERCENT * len(self.sets[i]):
                found.append((r, self.ids[i], shared, len(self.sets[i])))
        for width, keys in self.few.items():
            r, g = (row, h) if width == WIDTH else shingles(data, offsets, width)
            known = np.fromiter(keys, np.uint64, len(keys))
            at = np.flatnonzero(np.isin(g, known))
            for x, key in sorted(set(zip(r[at].tolist(), g[at].tolist()))):
                found += [(x, item, 1, 1) for item in keys[key]]
        return found


def leaks(docs: DataFrame, items: DataFrame, item_col: str = "item_id") -> DataFrame:
    """The columns of docs plus leaks: array of structs item_id, shared, size (empty: clean)."""
    small_batches(docs.sparkSession)
    rows = items.select(F.col(item_col).cast("long"), F.col("text"))
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "leaks"])
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("shared", T.IntegerType()), T.StructField("size", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int32()), ("size", pa.int32())]))
    out = docs.withColumn("leaks", F.array().cast(kind))
    stream = ((r[0], r[1]) for r in rows.toLocalIterator())
    while block := list(islice(stream, ITEM_BLOCK)):  # each block of items is a pass over docs
        shared = docs.sparkSession.sparkContext.broadcast(Items(block).plain)

        def find(batches, shared=shared):
            known = Items.of(shared.value)
            for batch in batches:
                old = batch.column(batch.schema.get_field_index("leaks")).to_pylist()
                for row0, data, offsets in chunks(batch, "text"):
                    for r, item, n, size in known.hits(data, offsets):
                        old[row0 + r] = [*(old[row0 + r] or []), {"item_id": item, "shared": n, "size": size}]
                cols = [c for c in batch.schema.names if c != "leaks"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cols], pa.array(old, arrow)], [*cols, "leaks"])

        out = out.mapInArrow(thrifty(find), T.StructType([*docs.schema.fields, T.StructField("leaks", kind)]))
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Only the documents that contain no item."""
    return leaks(docs, items).where(F.size("leaks") == 0).drop("leaks")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, clean, and the items found with their shared and own shingle counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("leaks") == 0).alias("clean"), F.size("leaks").alias("n_items"), F.to_json("leaks").alias("items"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES: dict = {}
