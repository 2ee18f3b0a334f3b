"""Reading the given tables and cutting plans in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_library_conf
from ..sources import scope


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, whole."""
    return apply_library_conf(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the current scope, a folder under
    ``spark.checkpoint.dir``, and read it back.

    The files are in the folder all executors share, so a lost executor costs
    only its running tasks and never replays what is above the cut."""
    return scope.current(apply_library_conf(df.sparkSession)).cut(df, f"llm_{name}", "zstd")
