"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then RUNS times; its time is the median, each run writing all rows to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from larkspur.session import session

RUNS = 3
SCAN_AGG = ["tpch_q01", "tpch_q06", "tpch_q14", "tpch_q19"]
JOIN_AGG = ["tpch_q03", "tpch_q04", "tpch_q05", "tpch_q07", "tpch_q08", "tpch_q10", "tpch_q12", "tpch_q13", "tpch_q15", "tpch_q17", "tpch_q18", "tpch_q21", "tpch_q22"]
SHAPES = ["distinct_on", "frame_groups", "win_sum_running", "rollup", "cube", "grouping_mask", "avg_decimal_exact", "anti_not_in_with_null"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session("larkspur-bench", cores=cpus, shuffle_partitions=cpus)
    from larkspur.plans import registry

    queries, took = registry.queries(), {}
    for name in SCAN_AGG + JOIN_AGG + SHAPES:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 4)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
