"""Importance resampling towards a target corpus, over hashed word features, in two Arrow passes.

A feature is a run of 1 to `longest` words; its bucket is the CRC-32 of its bytes modulo `BUCKETS`. Pass one counts buckets: each
partition sums `np.bincount` vectors and hands on one of them, and `treeReduce` merges these on the executors. The gain of a bucket
compares its share in the target with that in the raw corpus, both smoothed by one a bucket; it is a table of `BUCKETS` whole numbers. Pass two
gathers the broadcast gains and adds them up document by document with weighted `np.bincount`. Then each document gets Gumbel noise from a
hash of its id, and the highest scores are drawn: a sample without replacement, with chances in proportion to the exponential weights.

Ranks come from ranges of sorted scores and one count a range, so no task holds all documents that may be drawn.

Defined results: a null text has no words; a text without words has weight 0; documents of under `min_words` words are scored but never drawn; a very
long text is one row like any other; rows that repeat an id are documents each, with the same noise; a document without an id draws the noise
of an empty id; ties go to the smaller id (null last), then to the larger n_features; an empty target gives gains
that favour rare buckets, an empty corpus an empty result; extra columns go.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Stored, chunks, in_order, keep_columns, small_batches, thrifty
from tidemark.llm.kernels import crc32, runs

BUCKETS = 10_000
LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
SCALE = 1000


def _bytes() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return low, word


LOW, WORD = _bytes()


def buckets(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature, and the number of words of each row."""
    data = LOW[data]
    starts, ends, row = runs(WORD[data], offsets)
    n = len(starts)
    count = np.bincount(row, minlength=len(offsets) - 1)
    if not n:
        return row, row, count
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(WORD[data], out=solid[1:])
    # the words alone, one after the other: a spelling's CRC is taken once
    spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(solid[starts], solid[-1])), pa.py_buffer(data[WORD[data]])]).dictionary_encode()
    of, own = spelt.indices.to_numpy(), spelt.dictionary
    at = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, own.offset * 8)
    crc = crc32(np.frombuffer(own.buffers()[2], np.uint8), at[:-1], at[1:])[of]
    rows, found = [row], [crc % np.uint32(size)]
    space = np.array([32], np.uint8)
    for k in range(1, longest):  # the run of k words that starts at i goes on with word i + k of the same row
        crc = crc[: max(0, n - k)]
        crc = crc32(space, np.zeros(len(crc), np.int64), np.ones(len(crc), np.int64), crc)
        crc = crc32(data, starts[k:], ends[k:], crc)
        same = row[: len(crc)] == row[k:]
        rows.append(row[: len(crc)][same])
        found.append(crc[same] % np.uint32(size))
    return np.concatenate(rows), np.concatenate(found), count


def bucket_counts(texts: DataFrame, longest: int = LONGEST, size: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: one vector for each partition, merged in a tree."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch, "text"):
                total += np.bincount(buckets(data, offsets, longest, size)[1], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = keep_columns(texts, "text").mapInArrow(thrifty(count), "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64))
    return vectors.treeReduce(np.add, 3) if vectors.getNumPartitions() else np.zeros(size, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of smoothed shares) of each bucket."""
    size, own, wanted = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(SCALE * math.log(float((t + 1) * (own + size)) / float((s + 1) * (wanted + size)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def scored(docs: DataFrame, target: DataFrame, longest: int = LONGEST, size: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every document."""
    small_batches(docs.sparkSession)
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, longest, size), bucket_counts(target, longest, size)).astype(np.float64))

    def weigh(batches):
        for batch in batches:
            for row0, data, offsets in chunks(batch, "text"):
                row, bucket, words = buckets(data, offsets, longest, size)
                n = len(offsets) - 1
                weight = np.bincount(row, weights=gain.value[bucket], minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row0, n), pa.array(np.bincount(row, minlength=n)), pa.array(words), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    found = keep_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(thrifty(weigh), "doc_id long, n_features long, n_words long, weight long")
    ident = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(ident, 256), 1, 8), 16, 10).cast("double")
    return found.withColumn("score", F.col("weight") + F.floor(-SCALE * F.ln(-F.ln((h + 0.5) / float(1 << 32)))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = LONGEST, size: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document; rank from 1 for those drawn, else null."""
    every = Stored(scored(docs, target, longest, size, seed)).read()
    long = every.where(F.col("n_words") >= min_words)
    drawn = long.count() * percent // 100
    placed = in_order(long, F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"))
    rank = F.when(F.col("_at") < drawn, F.col("_at") + 1)
    rest = every.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).unionByName(rest, allowMissingColumns=True).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# CRC-32 by its table of 256 entries, made from the polynomial.
CRC_SQL = """RECURSIVE crc_bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def crc_sql(text: str, table: str = "t") -> str:
    """DuckDB: the CRC-32 of a non-empty text, where crc_table is joined."""
    octets = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 1 + 2 * i, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)])))"


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_H = f"CAST(CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE)"
QUERIES = {"op11_resample": op11_resample}
ORACLES = {
    "op11_resample": f"""
WITH {CRC_SQL},
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS words FROM documents),
own AS (SELECT r, unnest(words) AS w FROM d),
target AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
spelt AS (SELECT DISTINCT w FROM (SELECT w FROM own UNION ALL SELECT w FROM target)),
b AS (SELECT w, {crc_sql("w")} % {BUCKETS} AS bucket FROM spelt, crc_table),
s AS (SELECT bucket, count(*) AS s FROM own JOIN b USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM target JOIN b USING (w) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM own) AS all_s, (SELECT count(*) FROM target) AS all_t),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (all_s + {BUCKETS}) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (all_t + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), n),
w AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM own JOIN b USING (w) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, r, len(words) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({_H} + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM x WHERE n_features >= {MIN_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM x LEFT JOIN k USING (r)"""
}
