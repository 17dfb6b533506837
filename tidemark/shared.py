"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names, or one of our own where driver and executors are one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session may be gone at exit
        pass


_scratch: list[list] = []


class scratch:
    """Inside it, stored tables are dropped at the end unless they are kept."""

    def __enter__(self) -> scratch:
        self.made: list[Stored] = []
        _scratch.append(self.made)
        return self

    def keep(self, table: Stored) -> DataFrame:
        self.made.remove(table)
        return table.read()

    def __exit__(self, *error) -> None:
        _scratch.pop()
        for table in self.made:
            table.drop()


class Stored:
    """A table written to the shared folder: cuts lineage, and survives lost executors."""

    def __init__(self, df: DataFrame, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tidemark/{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(self.path)
        self.schema = df.schema
        atexit.register(_remove, self.spark, self.path)
        if _scratch:
            _scratch[-1].append(self)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    return Stored(df, codec).read()


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session has cores, for work on whole texts. A table that has as many already is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts and packed rows are long: hand at most BATCH_ROWS and about BATCH_BYTES of them to Python at once. A session that asks for less keeps its own."""
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, BATCH_ROWS)
    if not 0 < int(spark.conf.get(_BYTES).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")
