"""Time the headline queries and print one JSON line.

Each query is built and run to the end ``BENCH_RUNS`` times (3 unless set); the median counts. A full pass over the
result is forced with a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from paperloom.plans.catalogue import spark_queries
from paperloom.session import local_session

HEADLINE = [
    "dedup_by_hash",
    "upsert_documents",
    "assemble_pages",
    "confidence_stats",
    "parse_documents",
    "chunk_corpus",
    "build_text_index",
    "embed_distinct",
    "vector_topk",
    "vector_topk_ivf",
    "text_topk",
    "hybrid_search",
    "validate_documents",
    "rejection_notes",
    "action_stats",
    "status_changes_batch",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    built = spark_queries()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        times = []
        for _ in range(runs):
            started = time.perf_counter()
            built[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
