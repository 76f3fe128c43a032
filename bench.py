"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm the JVM and the Python workers, then $BENCH_RUNS
times; the median is reported.  Results are written to the noop sink, so every
row is produced and none is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftwork.plans.catalogue import QUERIES
from siftwork.session import get_session

HEADLINE = [
    "knn", "pairs_above", "isolation", "leak_curve", "hubness", "composed",
    "bm25_and", "hybrid_rrf", "describe_facets", "percentile_bucket",
    "facet_coverage", "export_record", "agreement_hist", "suspects",
    "coherence", "vocab_signals",
]


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session("siftwork-bench", master=f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in names:
        run(spark, name, sf)
        took[name] = round(statistics.median(run(spark, name, sf) for _ in range(runs)), 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
