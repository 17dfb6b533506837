"""A batch from its source to its tables: clean, score, embed, themes, radar, drift, audit."""

from __future__ import annotations

import json
import resource
import time
import uuid
from types import SimpleNamespace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audit, clean, drift, radar, scoring, themes as th
from tidemark.sources import reviews as source
from tidemark.sources import store


_GROUP, _NO_JOB = "spark.jobGroup.id", SimpleNamespace(stageIds=())


class Stages:
    """Figures of each named stage: wall time, rows and bytes that its Spark jobs read, wrote and shuffled, and peak memory.

    A stage's jobs are found by their group in the session's status store, which keeps the last thousand or so; what is run later than the stage counts where it runs.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.context = spark.sparkContext
        self.figures: dict[str, dict] = {}

    def run(self, name: str, f, *args):
        group, before = f"{name}-{uuid.uuid4().hex}", self.context.getLocalProperty(_GROUP)
        self.context.setLocalProperty(_GROUP, group)
        began = time.perf_counter()
        try:
            out = f(*args)
        finally:
            self.context.setLocalProperty(_GROUP, before)
        self.figures[name] = {"seconds": round(time.perf_counter() - began, 3), **self._of(group), "peak_driver_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10}
        return out

    def _of(self, group: str) -> dict[str, int]:
        scala = self.context._jsc.sc()
        scala.listenerBus().waitUntilEmpty()
        store, tracker = scala.statusStore(), self.context.statusTracker()
        jobs = tracker.getJobIdsForGroup(group)
        ids = {s for j in jobs for s in (tracker.getJobInfo(j) or _NO_JOB).stageIds}
        out = dict.fromkeys(("rows_in", "rows_out", "shuffle_bytes", "spilled_bytes", "peak_task_bytes", "peak_heap_bytes"), 0) | {"jobs": len(jobs)}
        for i in ids:
            try:
                s = store.lastStageAttempt(i)
            except Py4JJavaError:  # left out by Spark, or no longer kept
                continue
            for key, n in (("rows_in", s.inputRecords()), ("rows_out", s.outputRecords()), ("shuffle_bytes", s.shuffleWriteBytes()), ("spilled_bytes", s.diskBytesSpilled())):
                out[key] += n
            out["peak_task_bytes"] = max(out["peak_task_bytes"], s.peakExecutionMemory())
        executors = store.executorList(True)
        for k in range(executors.size()):
            peaks = executors.apply(k).peakMemoryMetrics()
            if peaks.isDefined():
                out["peak_heap_bytes"] = max(out["peak_heap_bytes"], peaks.get().getMetricValue("JVMHeapMemory"))
        return out


def _kept(spark: SparkSession, df: DataFrame, root: str | None, name: str) -> DataFrame:
    """The one barrier: the enriched rows are written once, for every later pass reads them."""
    if root is None:
        df = df.persist()
        df.count()
        return df
    path = f"{root}/_stage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def run_batch(spark: SparkSession, name: str, root: str | None = None, batch_id: str = "batch", scorer=scoring.lexicon, limit: int | None = None) -> dict[str, DataFrame]:
    """All tables of a batch by name; written and registered when `root` names a folder."""
    stages = Stages(spark)
    raw = stages.run("load", source.load, spark, name)
    if limit:
        raw = clean.even_sample(raw, limit)
    done = stages.run("clean", lambda: _kept(spark, clean.cleaned(raw), root, "cleaned"))
    report = clean.report(done)
    rows = scoring.scored(clean.kept_rows(done).withColumn("key", F.col("_pos").cast("long")), scorer(F.col("text_redacted")))
    rows = stages.run("embed", lambda: _kept(spark, th.embed(rows, "text_redacted"), root, "embedded"))
    rows, themes = stages.run("themes", th.discover, rows, "key", "text_redacted")
    themes = _kept(spark, themes, root, "themes")
    rows = stages.run("enriched", _kept, spark, rows.withColumn("similarity", F.col("theme_similarity")), root, "enriched")
    ids = rows.select(F.col("key").alias("k"), "review_id")
    reps = themes.select("theme_id", F.posexplode("representative_ids").alias("rank", "k")).join(ids, "k")
    reps = reps.groupBy("theme_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "review_id"))), lambda x: x["review_id"]).alias("representative_ids"))
    themes = themes.drop("representative_ids").join(reps, "theme_id", "left").join(th.rollup(rows).drop("size"), "theme_id", "left")
    issues = radar.radar(rows, themes)
    links = audit.links(themes, issues)
    placed = radar.placed(rows)
    verdict = audit.traceability(links, rows)
    reports = {
        "overview": th.overview(rows, th.rollup(rows)),
        "data_health": report,
        "drift": drift.report(placed, themes),
        "traceability": verdict,
    }
    blobs = None
    for key, df in reports.items():
        one = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("data")).select(F.lit(key).alias("key"), "data")  # a few rows each
        blobs = one if blobs is None else blobs.unionByName(one)
    blobs = blobs.unionByName(spark.createDataFrame([("performance", json.dumps(stages.figures))], "key string, data string"))
    meta = spark.createDataFrame([("source", json.dumps(name)), ("rules", json.dumps(radar.rules_text()))], "key string, value string")
    tables = {"reviews": rows.drop("embedding", "key", "_pos", "similarity", "theme_rank"), "themes": themes, "issues": issues, "evidence": links, "reports": blobs, "meta": meta}
    if root is not None:
        store.write_batch(spark, root, batch_id, tables)
        store.write_reports(spark, f"{root}/{batch_id}/reports", store.read_table(spark, root, batch_id, "reports"))
        store.register(spark, root, batch_id, {"source": name})
    return tables
