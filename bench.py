"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, default all below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from deskmill.plans import QUERIES  # noqa: E402
from deskmill.session import build_session  # noqa: E402

HEADLINE = ["kb_chunks", "segment_blocks", "kb_search", "rerank", "rrf_fuse", "knn", "retrieval_metrics", "daily_series", "period_summary",
            "idle_sessions", "burst_batches", "export_by_month", "mask_patterns", "detokenize", "idle_sessions_stream"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", master=f"local[{cpus}]", partitions=2 * cpus, memory="12g")
    spark.conf.set("spark.sql.debug.maxToStringFields", "25")
    QUERIES["status_groups"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
