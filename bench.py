"""Time the headline queries; prints one JSON line.

Every query is run to completion into a sink that keeps nothing. A short warm-up
pays for JVM start and class loading; each query's own planning is in its time.
"""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = (
    "page_text", "page_links", "custom_signals", "resolve_homepages", "keyword_analysis", "path_verdicts",
    "enrich_and_plan", "tokens", "token_overlap", "category", "fit_score", "filter_all_conditions", "upsert_plan",
    "upsert_contains", "reuse_analyses", "validate_answers", "price", "crm_jobs", "first_event_per_key",
    "resolve_event_domain", "stream_dedupe",
)


def main() -> None:
    from accountlake.spark import local_session
    from suite import QUERIES
    from suite.registry import SPREAD

    SPREAD["tasks"] = int(CPUS)
    spark = local_session(CPUS)
    spark.read.parquet(f"{SF_DIR}/events.parquet").groupBy("event_type").count().collect()
    times: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "pages_per_sec": round(pages / times["keyword_analysis"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
