"""Benchmark the headline queries.

Runs each query once to warm up, then BENCH_REPEATS times (default 3) with a
full write to the ``noop`` sink, and prints one JSON line with the median
seconds per query.  BENCH_SF_DIR (default /root/testdata/sf0.1) and
BENCH_CPUS (default 8) choose the data and the local parallelism.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from murmur.plans.catalog import QUERIES  # noqa: E402
from murmur.session import get_spark  # noqa: E402

HEADLINE = ["clean_text", "zipf_top50", "keyword_hits", "tfidf_topk", "cosine_topk", "hybrid_topk",
            "topic_clusters", "sentiment_over_time"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="murmur-bench", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        runs = []
        for i in range(repeats + 1):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:                               # the first run warms up
                runs.append(time.perf_counter() - t0)
            spark.catalog.clearCache()
        timings[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus, "repeats": repeats}))


if __name__ == "__main__":
    main()
