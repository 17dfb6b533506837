"""Extension: the weekly counts as a stream, with a watermark for late reviews. Batch windows end at the last review; a stream's
buckets are fixed weeks, so this is for monitoring, not for the radar's verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import shared_dir


def weekly_stream(events: DataFrame, ts: str = "ts", theme: str = "event_type", late: str = "2 days") -> DataFrame:
    """(window_start, theme_id, n) as an append stream; state is one counter a theme and open week."""
    stamped = events.withColumn("_t", F.col(ts).cast("timestamp"))
    counted = stamped.withWatermark("_t", late).groupBy(F.window("_t", "7 days"), F.col(theme).alias("theme_id")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "theme_id", "n")


def distinct_stream(events: DataFrame, key: str, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Re-delivered rows dropped by key within the watermark."""
    return events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def replay(spark, sf_dir: str) -> DataFrame:
    """The events table through weekly_stream to the end of its data. Every micro-batch writes the counts that it changed to a folder of its
    own (a repeated one writes the same folder again); the last count of a window and theme holds. Open windows are among them."""
    base = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{base}/counts/batch={batch}")

    query = weekly_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    counts = spark.read.parquet(f"{base}/counts")
    return counts.groupBy("window_start", "theme_id").agg(F.max_by("n", "batch").alias("n"))
