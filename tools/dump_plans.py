"""Write the physical-plan trees of the headline jobs to docs/PLANS.md.

    python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from issuelens.plans import registry  # noqa: E402
from issuelens.plans.inspect import plan_text  # noqa: E402
from issuelens.session import get_spark  # noqa: E402

JOBS = {
    "job_02": "exact top-3 neighbours, broadcast query matrix",
    "join_01": "exact top-3 neighbours, replicated blocks",
    "job_05": "tracker profile (normalized child tables)",
    "job_04": "generator scoring and evaluation",
    "sort_01": "held-out slice, deep-offset path",
}


def tree(plan: str) -> str:
    head = plan.split("\n\n(1)")[0]
    return "\n".join(line for line in head.splitlines() if line.strip())


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(shuffle_partitions=8)
    qs = registry.queries()
    out = ["# Physical plans of the headline jobs", "",
           f"Generated by `tools/dump_plans.py` on `{sf}` (initial adaptive plans; AQE may",
           "turn shuffle joins of small sides into broadcast joins at run time).", ""]
    for name, what in JOBS.items():
        p = plan_text(qs[name](spark, sf))
        t = tree(p)
        pats = {"shuffle Exchange": r"(?<!Broadcast)Exchange ", "BroadcastExchange": "BroadcastExchange",
                "WindowGroupLimit": "WindowGroupLimit", "MapInPandas": "MapInPandas",
                "FlatMapCoGroupsInPandas": "FlatMapCoGroupsInPandas", "ArrowEvalPython": "ArrowEvalPython",
                "CartesianProduct": "CartesianProduct", "BroadcastNestedLoopJoin": "BroadcastNestedLoopJoin",
                "HashAggregate": r"(?<!Object)HashAggregate", "ObjectHashAggregate": "ObjectHashAggregate"}
        counts = {k: len(re.findall(v, t)) for k, v in pats.items()}
        out += [f"## {name}: {what}", "",
                "Operator counts: " + ", ".join(f"{k} {v}" for k, v in counts.items() if v), "",
                "```", t, "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
