"""Time the headline queries; prints one JSON line.

Set BENCH_SF_DIR for the tables (default /root/testdata/sf0.1), BENCH_CPUS for the cores of the local master (default 8)
and BENCH_RUNS for the timed runs per query (default 2, the fastest counts). One untimed query starts the
session. Writing the inventory table that the others read is timed as ``write_inventory``, once; writing the tree of
files that ``live_tree`` lists is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from bucketscope import fixtures
from bucketscope.catalog import QUERIES
from bucketscope.session import build_session

HEADLINE = (
    "list_depth_rollup",
    "list_level",
    "filter_all",
    "sort_listing",
    "sort_key",
    "sort_size_then_key",
    "summarize_by_bucket",
    "summarize_by_prefix",
    "discover_prefixes",
    "scan_objects",
    "scan_versions",
    "scan_chosen_files",
    "live_tree",
    "scan_many_targets",
    "scan_many_targets_shuffled",
    "estimate_requests_parallel",
    "reconcile",
    "to_json",
    "to_aligned",
    "write_listing",
    "stream_listing",
    "stream_prefixes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    names = sys.argv[1:] or HEADLINE
    QUERIES["scan_buckets"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    started = time.perf_counter()
    fixtures.inventory_path(spark, sf_dir)
    seconds = {"write_inventory": round(time.perf_counter() - started, 3)}
    if "live_tree" in names:
        fixtures.tree_path(spark, sf_dir)
    for name in names:
        times = []
        for _ in range(runs):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(min(times), 3)
    print(json.dumps({
        "metric": "headline queries, sum of best times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": {n: round(rows / s) for n, s in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
