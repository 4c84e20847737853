"""Headline-query benchmark.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line. Each query is executed in full
with the no-op sink (nothing collected to the driver): one warm-up run, then
the median of three timed runs.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["flag_summary", "three_way_join", "fcfs_schedule", "classification_report",
            "schedule_audit", "regression_metrics", "quota_sample", "eligible_slots"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from apptflow.session import get_session
    from apptflow.plans.registry import queries
    spark = get_session(master=f"local[{cpus}]")
    q = queries()
    times = {}
    for name in names:
        runs = []
        for i in range(4):
            t0 = time.time()
            q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.time() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
