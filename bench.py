"""Benchmark of the headline jobs.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs every headline query to completion (``noop`` sink: the whole plan executes,
nothing is collected) and prints one JSON line with per-query seconds. Each query
first runs once untimed on the sf0.001 tables (JIT and Python worker warm-up,
steady-state numbers); the timed run is on ``BENCH_SF_DIR``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from issuelens.plans import registry  # noqa: E402
from issuelens.session import get_spark  # noqa: E402

HEADLINE = [
    "job_01",   # index build (text -> unit vectors)
    "job_02",   # exact top-3 neighbours of every vector (broadcast plan)
    "join_01",  # same through the replicated-block plan
    "job_03",   # classification prompts
    "job_04",   # generator scoring + evaluation
    "job_05",   # full tracker profile
    "agg_17",   # profile summary rows
    "job_06",   # held-out test slice
    "job_07",   # landing: pages -> issues, comments attached
    "str_01",   # incremental index (available-now stream, run three times)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                      extra={"spark.driver.memory": "16g"})
    qs = registry.queries()
    # warm the JVM and the Arrow Python workers once (not part of any query)
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(64).repartition(int(cpus)).mapInPandas(lambda it: it, "id long").collect()
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for n in names:
        if os.path.isdir(warm):
            qs[n](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
