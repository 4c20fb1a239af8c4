"""Benchmark: run the headline queries on $BENCH_SF_DIR (default sf0.1) on
local[$BENCH_CPUS] and print one JSON line with per-query seconds.

Each query runs to completion through the ``noop`` sink (the whole plan
executes, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from limnos.catalog import REGISTRY  # noqa: E402
from limnos.session import get_session, release  # noqa: E402

HEADLINE = [
    "logger_daily", "logger_readings", "logger_status", "logger_trimmed", "inventory_export",
    "station_master", "baseline_final", "tp_final", "duplicate_samples", "watershed_hierarchy",
    "station_watersheds", "landcover_shares", "landcover_vs_state", "plan_attributes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=2 * cpus, app_name="limnos-bench")
    # warm-up (not timed): JVM, JIT and code cache on the smallest data, so
    # the first timed query does not pay for them
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("logger_daily", "baseline_final", "landcover_shares"):
            REGISTRY[name][0](spark, warm_dir).write.format("noop").mode("overwrite").save()
    REGISTRY["station_master"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        release(spark)              # not timed: the query's intermediate tables
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
