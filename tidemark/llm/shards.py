"""Uniform sharding with exact sizes through a hypergeometric communication matrix.

Rows are written once with their place (partition, number within it). The matrix says how many rows each
partition sends to each cell; a cell is a block of one shard, and cell sizes are fixed beforehand, so shards
differ by one row at most. Row i of the matrix is drawn by descending a binary tree over partitions:
at each node the left half's counts are multivariate hypergeometric given the node's, from a generator seeded
by the node, so every task (and every retry) derives its own rows of one same matrix. Each partition deals its
counts out by a random permutation, rows are exchanged by cell, and each cell is permuted again.

Defined results: a null text counts as empty; repeated rows and repeated ids are separate rows; an empty table
gives an empty result; extra columns travel along unless named like the operator's own (shard, slot, _row, _cell).
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Stored, small_batches, thrifty

PART_BITS = 33
EXACT_LIMIT = 10**9


def _hypergeometric_large(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Ratio-of-uniforms rejection for populations beyond the library's limit."""
    low, high, pop = min(good, bad), max(good, bad), good + bad
    m = min(draws, pop - draws)
    if m == 0 or low == 0:
        z = 0
    else:
        p = low / pop
        centre, width = m * p + 0.5, math.sqrt((pop - m) * draws * p * (1 - p) / (pop - 1) + 0.5)
        scale = 2 * math.sqrt(2 / math.e) * width + 3 - 2 * math.sqrt(3 / math.e)
        mode = ((m + 1) * (low + 1)) // (pop + 2)
        weight = lambda k: math.lgamma(k + 1) + math.lgamma(low - k + 1) + math.lgamma(m - k + 1) + math.lgamma(high - m + k + 1)
        top, edge = weight(mode), min(min(m, low) + 1, int(centre + 16 * width))
        while True:
            x, y = rng.random(), rng.random()
            w = centre + scale * (y - 0.5) / x if x else -1.0
            if 0 <= w < edge:
                z = int(w)
                if 2 * math.log(x) <= top - weight(z):
                    break
    z = m - z if good > bad else z
    return good - z if m < draws else z


def _split(rng: np.random.Generator, sizes: np.ndarray, draws: int) -> np.ndarray:
    """How many of `draws` rows fall to each cell of these sizes; beyond the library's limit, cells are halved until each half is within it."""
    total = int(sizes.sum())
    if total < EXACT_LIMIT:
        return rng.multivariate_hypergeometric(sizes, draws, method="marginals")
    if len(sizes) == 1:
        return np.array([draws], np.int64)
    mid = len(sizes) // 2
    left = int(sizes[:mid].sum())
    first = _hypergeometric_large(rng, left, total - left, draws)
    return np.concatenate((_split(rng, sizes[:mid], first), _split(rng, sizes[mid:], draws - first)))


def matrix_row(part: int, counts: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix: rows of that partition for each cell."""
    lo, hi, left = 0, len(counts), cells.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = _split(np.random.default_rng([seed, lo, hi]), left, int(counts[lo:mid].sum()))
        if part < mid:
            hi, left = mid, first
        else:
            lo, left = mid, left - first
    return left


def cell_sizes(rows: int, shards: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, shard, first slot) of each cell; every shard is cut into cells of about `block` rows."""
    per = rows // shards + (np.arange(shards) < rows % shards)
    pieces = max(1, -(-int(per.max(initial=0)) // block))
    sizes = (per[:, None] // pieces + (np.arange(pieces) < per[:, None] % pieces)).astype(np.int64)
    first = np.cumsum(sizes, axis=1) - sizes
    return sizes.ravel(), np.repeat(np.arange(shards), pieces), first.ravel()


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 17, block: int = 4096) -> DataFrame:
    """All columns of docs, plus shard (int) and slot (long, gapless from 0 in each shard)."""
    small_batches(docs.sparkSession)
    clash = {"shard", "slot", "_row", "_cell"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in clash])
    table = Stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    placed = table.read()
    found = placed.groupBy(F.shiftright("_row", PART_BITS).alias("part")).count().orderBy("part").collect()  # one row for each partition
    parts = np.array([r["part"] for r in found], np.int64)
    counts = np.array([r["count"] for r in found], np.int64)
    cells, shard_of, first = cell_sizes(int(counts.sum()), shards, block)

    def deal(batches):
        known: OrderedDict = OrderedDict()
        for batch in batches:
            row = batch.column("_row").to_numpy()
            cell = np.empty(len(row), np.int32)
            part = row >> PART_BITS
            for p in np.unique(part):
                if p not in known:
                    i = int(np.searchsorted(parts, p))
                    own = np.repeat(np.arange(len(cells), dtype=np.int32), matrix_row(i, counts, cells, seed))
                    known[p] = np.random.default_rng([seed, 1, i]).permutation(own)
                    if len(known) > 4:
                        known.popitem(last=False)
                at = part == p
                cell[at] = known[p][row[at] & ((1 << PART_BITS) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "_cell"])

    schema = T.StructType([*placed.schema.fields, T.StructField("_cell", T.IntegerType())])
    dealt = placed.mapInArrow(thrifty(deal), schema)
    window = Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed), "_row"), "_row")
    ranked = dealt.withColumn("_rank", F.row_number().over(window) - 1)
    pieces = len(cells) // shards
    per, extra = divmod(int(counts.sum()), shards)
    shard, piece = F.floor(F.col("_cell") / pieces).cast("int"), F.pmod(F.col("_cell"), F.lit(pieces))
    size = F.lit(per) + F.when(shard < extra, 1).otherwise(0)
    start = piece * F.floor(size / pieces) + F.least(piece, size % pieces)
    return ranked.withColumns({"shard": shard, "slot": (start + F.col("_rank")).cast("long")}).drop("_cell", "_rank", "_row")


SHARDS = 24


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shuffle_into_shards(docs, SHARDS)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op8_shard": op8_shard}
ORACLES: dict = {}
