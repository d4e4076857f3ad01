"""Time the headline jobs; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from scrollwork.plans import jobs
from scrollwork.session import get_session

HEADLINE = [
    "route_counts", "repeated_lines", "boilerplate_flags", "chunk_tokens", "section_words", "enforce_sizes", "postings_stats",
    "bm25_topk", "budgeted_retrieval", "cosine_topk", "inventory_fold", "counter_fold", "threshold_crossings", "state_as_of",
    "failure_streak", "problem_turns", "thread_progress", "session_recap", "place_files", "extract_calibration",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        jobs.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
