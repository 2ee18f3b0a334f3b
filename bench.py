"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf": ...}.
Each query is run to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver). Two end-to-end timings follow
the production flow: ``elt_run`` builds the order fact, stages it as a table,
validates it and swaps it in; ``analysis_all_reports`` computes every report from that saved fact with
the enriched base persisted once.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from splitlift.plans import pipeline  # noqa: E402
from splitlift.plans.catalog import QUERIES  # noqa: E402
from splitlift.session import build_session  # noqa: E402
from splitlift.sources import fixtures as fx  # noqa: E402

HEADLINE = [
    "clean_text", "dedup_latest", "order_fact", "order_item_metrics", "customer_segments",
    "ab_group_metrics", "top_cities", "weekly_city_metrics", "weekly_city_lift",
    "daily_segment_lift", "monthly_segment_metrics", "welch_test",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    # Warm-up (JIT, Python workers) on the smallest tables when they are there.
    warm_dir = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    warm_dir = warm_dir if os.path.isdir(warm_dir) else sf_dir
    for name in ("weekly_city_lift", "clean_text"):
        _run(QUERIES[name](spark, warm_dir))

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        _run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)

    # End-to-end: ELT run (fact -> cut -> gate -> full refresh), then reports.
    raw = pipeline.RawInputs(fx.fx_orders(spark, sf_dir), fx.fx_consumers(spark, sf_dir),
                             fx.fx_merchants(spark, sf_dir), fx.fx_abtest(spark, sf_dir))
    t0 = time.perf_counter()
    # Table target, as in the analysed workload: staged once, gated, swapped in.
    pipeline.run_elt(raw, "bench_order_fact", run_date="bench", fmt="table")
    times["elt_run"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    reports = pipeline.run_analysis(spark.read.table("bench_order_fact"))
    pipeline.write_reports(reports, None, fmt="noop", parallel=4)
    times["analysis_all_reports"] = round(time.perf_counter() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_wall_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
