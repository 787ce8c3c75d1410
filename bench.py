"""Headline queries, timed. Prints one JSON line.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` (default 8). Each
query runs once to warm up at the same scale and then three times, of which the median counts; results go to Spark's
no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from passagework.session import local_session  # noqa: E402
from workload.catalog import QUERIES  # noqa: E402

HEADLINES = (
    "nearest_vectors", "nearest_in_category", "search_above_threshold", "search_approximately",
    "clean_text", "clean_for_embedding", "sections", "fixed_windows", "recursive_chunks",
    "processed_documents", "hash_vectors", "chunk_vectors", "chunk_ordinals", "page_assembly", "collection_stats",
    "ingest_statistics", "packed_context", "messages", "request_validation", "rebuilt_collection",
    "answers", "answers_above_threshold", "search_results",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINES
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run = QUERIES[name][0]
        times = []
        for attempt in range(4):  # the first one compiles code and does not count
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if os.environ.get("BENCH_VERBOSE"):
                print(name, attempt, round(times[-1], 3), file=sys.stderr, flush=True)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))[2:],
    }))


if __name__ == "__main__":
    main()
