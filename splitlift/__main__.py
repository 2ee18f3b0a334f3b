"""Command-line entry points for the two runs.

    python -m splitlift elt --orders P --consumers P --merchants P --abtest P \\
        --target PATH [--run-date YYYY-MM-DD] [--partitions N]
    python -m splitlift analysis --fact PATH|TABLE [--format parquet|table|...] \\
        --out DIR [--k 3] [--parallel 4]

Both use the active cluster session when launched through spark-submit (its
``spark.checkpoint.dir`` is used for plan cuts), or a local one otherwise.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession

from .plans import pipeline
from .session import apply_library_conf, checkpoint_dir
from .sources import readers, scope


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("splitlift").getOrCreate()
    apply_library_conf(spark)
    checkpoint_dir(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="splitlift")
    sub = parser.add_subparsers(dest="command", required=True)
    elt = sub.add_parser("elt", help="build, validate and save the order fact")
    for name in ("orders", "consumers", "merchants", "abtest", "target"):
        elt.add_argument(f"--{name}", required=True)
    elt.add_argument("--run-date", default=dt.date.today().isoformat())
    elt.add_argument("--partitions", type=int, default=None)
    elt.add_argument("--format", default="parquet")
    ana = sub.add_parser("analysis", help="compute and write every report")
    ana.add_argument("--fact", required=True)
    ana.add_argument("--format", default="parquet", help="'table', or a file format such as parquet or delta")
    ana.add_argument("--out", required=True)
    ana.add_argument("--k", type=int, default=3)
    ana.add_argument("--parallel", type=int, default=4)
    args = parser.parse_args(argv)

    spark = _session()
    if args.command == "elt":
        raw = pipeline.load_raw(spark, {"orders": args.orders, "consumers": args.consumers,
                                        "merchants": args.merchants, "abtest": args.abtest},
                                partitions=args.partitions)
        report = pipeline.run_elt(raw, args.target, args.run_date, fmt=args.format)
        print(json.dumps(report, default=str))
    else:
        fact = readers.read_saved(spark, args.fact, args.format)
        proof = readers.saved_report(spark, args.fact, args.format) or {}
        with scope.Scope(spark, "analysis"):
            out = pipeline.run_analysis(fact, export_dir=f"{args.out}/csv", k=args.k,
                                        orders_unique=proof.get("key_is_unique"))
            done = pipeline.write_reports(out, f"{args.out}/parquet", parallel=args.parallel)
        print(json.dumps({"reports": done}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
