"""Bytes that the period reports shuffle, by formulation (figures of PLANS.md).

Usage: python tools/shuffle_bytes.py [sf_dir]
The figures come from Spark's event log, written to a folder of its own.
"""

from __future__ import annotations

import glob
import json
import sys
import tempfile
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from splitlift.operators import cube, distinct, metrics  # noqa: E402
from splitlift.plans import pipeline  # noqa: E402
from splitlift.plans.catalog import _fact  # noqa: E402
from splitlift.session import build_session  # noqa: E402
from splitlift.sources import scope  # noqa: E402
from splitlift.sources.sinks import materialize  # noqa: E402


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    logs = tempfile.mkdtemp(prefix="splitlift-events-")
    spark = build_session("local[8]", extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{logs}",
                                             "spark.eventLog.rolling.enabled": "false",
                                             "spark.eventLog.compress": "false"})
    took = {}

    def run(name, *frames):
        spark.sparkContext.setJobDescription(name)
        began = time.time()
        for df in frames:
            df.write.format("noop").mode("overwrite").save()
        took[name] = time.time() - began
        spark.sparkContext.setJobDescription(None)

    with scope.Scope(spark):
        fact = materialize(_fact(spark, sf), "fact")
        base = materialize(pipeline.analysis_base(fact, orders_unique=True).select(*pipeline.REPORT_COLUMNS), "base")
        top = materialize(metrics.top_k(base), "top")
        run("warm-up", metrics.top_k(base))
        run("six reports of the base, count_distinct", *[
            metrics.period_metrics(metrics.restrict_to(base, top) if g == "city" else base, cube.PERIODS[p],
                                   cube.GROUPINGS[g], orders_unique=True).where("abtest_group is not null")
            for p, g in cube.COMBINATIONS])
        run("customer-day table", cube.customer_days(base))
        days = materialize(cube.customer_days(base), "days")
        run("period cube, customers in place", cube.period_cube(days, top))
        numbers = materialize(distinct.dense_numbers(days, cube.CUSTOMER, materialize), "numbered")
        run("day bitmaps", cube.day_bitmaps(days, numbers, top))
        maps = materialize(cube.day_bitmaps(days, numbers, top), "maps")
        run("period cube from stored bitmaps", cube.bitmap_cube(days, maps, top))
        print(f"base {base.count()} rows, days {days.count()} rows, bitmaps {maps.count()} rows")
    spark.stop()
    job_of, written = {}, {}
    with open(glob.glob(f"{logs}/*")[0]) as f:
        for event in map(json.loads, f):
            if event["Event"] == "SparkListenerJobStart":
                name = event["Properties"].get("spark.job.description")
                job_of.update({s: name for s in event["Stage IDs"]})
            elif event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                name = job_of.get(event["Stage ID"])
                written[name] = written.get(name, 0) + event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
    for name, seconds in took.items():
        print(f"{name:45s} {written.get(name, 0) / 1e6:8.2f} MB {seconds:6.2f} s")


if __name__ == "__main__":
    main(sys.argv)
