"""Times the headline queries on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidefuse.session import local_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINES = (
    "gpu_rollup", "training_rollup", "align_sources", "fill_missing", "feature_matrix", "matrix_stats",
    "label_fault_windows", "fault_coverage", "sustained_threshold", "no_improvement", "counter_rate",
    "rolling_features", "describe_series", "scan_log", "log_events", "store_append", "query_time_range",
    "chunk_numbers", "split_cap", "overlap_chunks", "plan_report", "stream_parse_append",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINES
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))

    def once(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(RUNS)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median warm query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
