"""Data-quality checks on a table: key uniqueness, key never NULL, non-empty."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import skew


class DataQualityError(Exception):
    """Raised by :func:`require` when a check fails."""


def dq_report(df: DataFrame, key: str | Sequence[str] = "order_id") -> DataFrame:
    """One aggregate pass -> one row of counts and pass/fail flags.

    A composite key is unique when no two rows share all its values; a key is
    NULL when any of its columns is NULL.
    """
    keys = [key] if isinstance(key, str) else list(key)
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    full_key = F.when(~any_null, F.struct(*[F.col(k) for k in keys]))
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(full_key).alias("n_keyed"),
        F.count_distinct(full_key).alias("n_distinct_keys"),
        F.count_if(any_null).alias("n_null_keys"),
    )
    return counts.withColumns({
        "key_is_unique": (F.col("n_distinct_keys") == F.col("n_keyed")),
        "key_never_null": (F.col("n_null_keys") == 0),
        "has_rows": (F.col("n_rows") > 0),
    })


def watched(df: DataFrame, key: str, watch: Observation, tops: Sequence[str] = ()) -> DataFrame:
    """``df``, whose rows and NULL keys are counted while it passes by, with candidates
    for hot values of the columns ``tops``."""
    return df.observe(watch, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(key).isNull()).alias("n_null_keys"),
                      *[skew.top_keys(c).alias(f"top_{c}") for c in tops])


def observed_hot(watch: Observation, tops: Sequence[str], tasks: int) -> dict[str, list[str]]:
    """Hot values of the columns that :func:`watched` looked at."""
    seen = _observed(watch)
    return {c: skew.hot(seen.get(f"top_{c}"), seen.get("n_rows", 0), tasks) for c in tops}


def _observed(watch: Observation) -> dict:
    try:
        return watch.get
    except Py4JJavaError:  # the optimizer left the node out: there is no row of counts
        return {}


def observed_report(before: Observation, after: Observation) -> dict | None:
    """The report of :func:`dq_report` for a table that joins made of one whose key is
    unique, from counts taken while it was written; None where they prove nothing.

    Left joins keep every row, and repeat it if a key of the other side repeats. So
    with as many rows (and NULL keys) after the joins as before them, the key is still
    unique. Counts that differ may also come from tasks that ran twice after an
    executor was lost, or from nodes that the optimizer left out of an empty plan; the
    caller then counts what was written."""
    counts = [{k: v for k, v in _observed(watch).items() if not k.startswith("top_")} for watch in (before, after)]
    if not counts[0] or counts[0] != counts[1]:
        return None
    rows, nulls = counts[0]["n_rows"], counts[0]["n_null_keys"]
    return {"n_rows": rows, "n_keyed": rows - nulls, "n_distinct_keys": rows - nulls, "n_null_keys": nulls,
            "key_is_unique": True, "key_never_null": nulls == 0, "has_rows": rows > 0}


def require(report: DataFrame | dict) -> dict:
    """Gate: raise :class:`DataQualityError` naming the failing checks."""
    row = report if isinstance(report, dict) else report.first().asDict()
    failed = [name for name in ("key_is_unique", "key_never_null", "has_rows") if not row[name]]
    if failed:
        raise DataQualityError(f"validation failed: {', '.join(failed)} ({row})")
    return row


def require_unique(df: DataFrame, key: str, name: str) -> None:
    """Raise unless no two rows of a dimension share ``key`` (NULL keys never join
    and are left out): a duplicate would multiply the rows of the fact."""
    twice = (df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
             .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("example")).first())
    if twice.n:
        raise DataQualityError(f"{name}: {twice.n} values of {key} occur more than once, e.g. {twice.example!r}")


def _dtype_group(dtype: str) -> str:
    if dtype in ("string", "boolean"):
        return "text"
    if dtype == "double":
        return "float"
    return "other"


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: Spark type, type group (text/float/other) and NULL count,
    from one aggregate pass unpivoted into rows."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = nulls.unpivot([], df.columns, "column_name", "n_null")
    kinds = [(c, t, _dtype_group(t)) for c, t in df.dtypes]
    kind_map = F.create_map(*[x for c, t, _ in kinds for x in (F.lit(c), F.lit(t))])
    group_map = F.create_map(*[x for c, _, g in kinds for x in (F.lit(c), F.lit(g))])
    return long.select(
        "column_name",
        kind_map[F.col("column_name")].alias("data_type"),
        group_map[F.col("column_name")].alias("type_group"),
        F.col("n_null").cast("long").alias("n_null"),
    )
