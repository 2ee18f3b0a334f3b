"""Summarise the physical plan of every query of the reference's operators (markdown table).

Usage: python tools/plan_summary.py [sf_dir]
Counts operators of the plans as Spark makes them before it runs anything (no side's
size is known yet), so a run may turn further joins into broadcasts.
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from splitlift.plans.catalog import QUERIES  # noqa: E402
from splitlift.session import build_session  # noqa: E402

COUNTED = [
    ("exchanges", r"\bExchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)"),
    ("broadcasts", r"\bBroadcastExchange\b"),
    ("bhj", r"\bBroadcastHashJoin\b"),
    ("smj", r"\bSortMergeJoin\b"),
    ("hash/sort aggs", r"\b(HashAggregate|SortAggregate|ObjectHashAggregate)\b"),
    ("window", r"\bWindow\b"),
    ("expand", r"\bExpand\b"),
    ("arrow py", r"\bArrowEvalPython\b|\bMapInArrow\b"),
    ("row py", r"\bBatchEvalPython\b"),
]


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 16)
    print("| query | " + " | ".join(n for n, _ in COUNTED) + " |")
    print("| --- | " + " | ".join("---:" for _ in COUNTED) + " |")
    for name, q in QUERIES.items():
        df = q(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = [len(re.findall(p, plan)) for _, p in COUNTED]
        print(f"| {name} | " + " | ".join(str(c) for c in counts) + " |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
