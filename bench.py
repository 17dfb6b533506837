"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import catalogue
from tidemark.session import get_session

HEADLINE = (
    "radar_status", "radar_report", "radar_weekly_buckets", "radar_evidence_topk", "radar_segment_lift", "drift_psi_sentiment", "drift_weekly", "drift_ks_d", "theme_rollup", "overview_kpis",
    "clean_tidy", "ingest_dedupe", "pii_redact", "leak_scan", "profile_text", "centroid", "nearest_centroid", "ctfidf_terms", "coverage_stems", "eval_summary", "threshold_tune", "reviews_page", "reviews_search", "traceability",
)


def timed(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    """`value` and `queries` are first (cold) runs, `warm` the second ones in the same session."""
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("tidemark-bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    cold, warm = ({name: timed(spark, name, sf_dir) for name in HEADLINE} for _ in range(2))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(cold.values()), 3), "unit": "sec", "queries": cold, "warm_value": round(sum(warm.values()), 3), "warm": warm, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
