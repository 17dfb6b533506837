"""What the operators share: row keys and Arrow helpers, and the stored tables of the engine."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import BATCH_BYTES, BATCH_ROWS, Stored, scratch, shared_dir, small_batches, stored

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "Stored", "binary_rows", "chunks", "give_back", "in_order", "keep_columns", "lists", "partitions", "scratch", "shared_dir", "small_batches", "stored", "thrifty"]


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle of the session makes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Yield (first row, data, offsets): runs of rows with about `limit` bytes of text; null is empty.

    `data` is a view on the batch, `offsets` has one entry more than the run has rows.
    """
    col = batch.column(column)
    col = col.cast(pa.large_string()) if col.null_count == 0 else col.fill_null("").cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def binary_rows(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def lists(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))


def give_back() -> None:
    """What this process has freed goes back to the system; allocators keep it otherwise, while a worker waits for its next task or the driver for its jobs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def thrifty(run):
    """A function for mapInArrow that gives memory back when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, under exactly these names (lookups ignore case; extra columns go)."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def in_order(df: DataFrame, *order) -> DataFrame:
    """df, stored, with _at: its place (from 0) in the given order over all rows. Ranges of rows are sorted each in a task; one count for each is all that is collected."""

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int64)), pa.array(np.arange(at, at + len(batch)))], [*batch.schema.names, "_part", "_in"])
            at += len(batch)

    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_in", T.LongType())])
    placed = Stored(df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order).mapInArrow(number, schema)).read()
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_part long, _before long")
    return placed.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_before") + F.col("_in")).drop("_part", "_before", "_in")
