"""Toxicity scores from non-negative positive-unlabelled learning.

A linear model over word features is trained from confirmed toxic texts and unlabelled ones, by gradient
steps on the non-negative risk  pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])  with the logistic loss; when the
second part falls below -`slack`, the step goes the other way on that part alone. The class prior pi is the toxic
share of the labels that may be learned from: the one thing for which negative labels are used. Features are a document's distinct words and their first four to
six bytes, hashed to 2**22 places; those that are clearly more frequent in the positive texts than
in the unlabelled ones are kept. Fitting takes at most `positives` and `unlabelled` documents of different id or text, the least
by a hash of the id (a documented bound); scoring reads every whole text, and the model's size is fixed.

Defined results: a null or empty text is scored by the model's bias alone; repeated rows score alike; a null id
is never held out and never learned from; null labels are ignored; without a positive label every score is 0; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import chunks, give_back, small_batches, thrifty
from tidemark.llm.kernels import U, prefix, span_hash, words

BITS = 22
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Fit:
    positives: int = 4000
    unlabelled: int = 8000
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4
    slack: float = 0.0
    min_share: float = 0.005
    min_docs: int = 3
    ratio: float = 2.5
    deviations: float = 4.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every word and word prefix, with repeats."""
    starts, ends, row = words(data, offsets)
    if not len(starts):
        return row, row
    # a word without the punctuation around it: bytes 0x21-0x2F, 0x3A-0x40 at either end
    punct = ((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64))
    for _ in range(2):
        starts = np.where((ends > starts) & punct[np.minimum(starts, len(data) - 1)], starts + 1, starts)
        ends = np.where((ends > starts) & punct[ends - 1], ends - 1, ends)
    some = ends > starts
    starts, ends, row = starts[some], ends[some], row[some]
    sums = prefix(data)
    shift = U(64 - BITS)
    found, rows = [span_hash(sums, starts, ends) >> shift], [row]
    for n in PREFIXES:
        long = ends - starts > n
        s = starts[long]
        found.append((span_hash(sums, s, s + n) * U(0x9E3779B97F4A7C15 + 2 * n)) >> shift)
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float


def score_rows(table: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    row, place = features(data, offsets)
    f = np.full(rows, bias)
    if len(row):
        at = np.flatnonzero(table[place] != 0)
        key = np.unique(row[at] * (1 << BITS) + place[at])
        f += np.bincount(key >> BITS, weights=table[key & ((1 << BITS) - 1)].astype(np.float64), minlength=rows)
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _counted(docs: list[np.ndarray]) -> np.ndarray:
    """In how many documents each place occurs, from a few hundred documents at a time."""
    out = np.zeros(1 << BITS, np.int32)
    for i in range(0, len(docs), 200):
        places, n = np.unique(np.concatenate(docs[i : i + 200]), return_counts=True)
        out[places] += n.astype(np.int32)
    return out


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, fit: Fit = Fit()) -> Model:
    """pos and unl: each document's distinct places."""
    if not pos or not unl or prior <= 0:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    size = 1 << BITS
    dp = _counted(pos)
    places = np.flatnonzero(dp >= max(fit.min_docs, fit.min_share * len(pos)))
    dp, u = dp[places], (_counted(unl)[places] + 1) / (len(unl) + 1)
    chance = len(pos) * u
    clear = dp - chance >= fit.deviations * np.sqrt(chance + 1)
    places = places[(dp >= fit.ratio * chance) & clear]
    at = np.full(size, -1, np.int32)
    at[places] = np.arange(len(places))

    def rows(docs):
        own = [c[c >= 0] for c in (at[x] for x in docs)]
        n = np.array([len(x) for x in own])
        return np.repeat(np.arange(len(docs)), n), np.concatenate(own) if own else np.zeros(0, np.int32)

    (pr, pc), (ur, uc) = rows(pos), rows(unl)
    w, b = np.zeros(len(places)), float(np.log(prior / (1 - prior))) if prior < 1 else 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, fit.steps + 1):
        fp = np.bincount(pr, weights=w[pc], minlength=len(pos)) + b
        fu = np.bincount(ur, weights=w[uc], minlength=len(unl)) + b
        soft = lambda z: np.logaddexp(0, z)
        negative = soft(fu).mean() - prior * soft(fp).mean()
        gp = -prior * sig(-fp) / len(pos)  # of the positive part
        np_, nu = -prior * sig(fp) / len(pos), sig(fu) / len(unl)  # of the negative part
        if negative < -fit.slack:
            gp, np_, nu = np.zeros_like(gp), -np_, -nu
        gp = gp + np_
        g = np.bincount(pc, weights=gp[pr], minlength=len(w)) + np.bincount(uc, weights=nu[ur], minlength=len(w)) + fit.decay * w
        g = np.append(g, gp.sum() + nu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = fit.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(places, w, float(b))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sampled(docs: DataFrame, most: int, seed: int) -> list[np.ndarray]:
    """Distinct places of at most `most` documents, rows of the same id and text being one."""

    def find(batches):
        for batch in batches:
            for row0, data, offsets in chunks(batch, "text"):
                row, place = features(data, offsets)
                key = np.unique(row * (1 << BITS) + place) if len(row) else row
                cut = np.searchsorted(key, np.arange(len(offsets)) << BITS)
                found = [(key[a:b] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                own = slice(row0, row0 + len(found))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[own], batch.column("t")[own], pa.array(found, pa.binary())], ["doc_id", "t", "p"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    keys = docs.select("doc_id", "t").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "t").limit(most)
    rows = docs.join(F.broadcast(keys), ["doc_id", "t"], "left_semi").select("doc_id", "t", "text").mapInArrow(thrifty(find), "doc_id long, t long, p binary")
    found = rows.groupBy("doc_id", "t").agg(F.first("p").alias("p")).orderBy("doc_id", "t").select("p").toArrow().column("p")
    return [np.frombuffer(p.as_buffer(), np.int32) for chunk in found.chunks for p in chunk]  # views on the table


def fit_model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), seed: int = 3) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic); only rows that aren't held out are used."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    pos = known.where("toxic = 1").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit.positives).select("doc_id")
    own = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    model = train(_sampled(own.join(F.broadcast(pos), "doc_id", "left_semi"), fit.positives, seed), _sampled(own, fit.unlabelled, seed), prior, fit)
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs plus score."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"])
    shared = docs.sparkSession.sparkContext.broadcast((model.places, model.weights, model.bias))

    def run(batches):
        places, weights, bias = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[places] = weights
        for batch in batches:
            out = [score_rows(table, bias, data, offsets) for _, data, offsets in chunks(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*batch.schema.names, "score"])

    return docs.mapInArrow(thrifty(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict = {}
