"""Sinks: plan cuts in the shared checkpoint folder, full-refresh targets and report
export."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from . import scope, versioned


def materialize(df: DataFrame, name: str, run_date: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the current scope (a folder under the session's
    shared checkpoint folder) and read it back: later actions start from the files
    instead of re-running the joins, and lost executors do not replay the lineage. The
    files stay until the scope is closed."""
    return scope.current(df.sparkSession).cut(df, f"{name}_{run_date}" if run_date else name)


def save_full(df: DataFrame, target: str, fmt: str = "parquet",
              check: Callable[[DataFrame], dict] | None = None) -> dict:
    """Full refresh: a new version of the whole target (a path, or a table name when
    ``fmt='table'``), current once it is written and ``check`` has passed it."""
    return versioned.refresh(df, target, check or (lambda written: {}), fmt)


def export_report(df: DataFrame, path: str, sort_by: Sequence[str], single_file: bool = True
                  ) -> None:
    """Sorted report as CSV with a header, replacing previous content.

    Reports are already aggregated (periods x groups), so one output file is
    small; ``single_file=False`` keeps the writers parallel."""
    out = df.orderBy(*sort_by)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)
