"""Customer segmentation by order count percent-rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import segment_label
from ..sources.sinks import materialize
from . import skew


def orders_per_customer(df: DataFrame, customer: str = "customer_id", order: str = "order_id",
                        orders_unique: bool = False) -> DataFrame:
    """customer -> number of distinct orders (the NULL customer is a group too). With
    a key proven unique, a plain count combines map-side to a row per customer."""
    n = F.count(order) if orders_unique else F.count_distinct(order)
    return df.groupBy(customer).agg(n.alias("orders_total"))


def customer_percent_rank(counts: DataFrame, value: str = "orders_total") -> DataFrame:
    """``percent_rank()`` over all customers ordered by ``value``, without
    sorting the customers in one task.

    percent_rank = (customers with a strictly smaller value) / (customers - 1),
    0 for a single customer. For whole numbers (counts), those numbers come from the
    histogram of values, which has at most sqrt(2 * orders) rows (k distinct positive
    counts need at least k(k+1)/2 orders): ~450k rows for 1e11 orders. That bound is
    what makes the single-partition running sum over it and the broadcast back safe.
    Other values have no such bound: see :func:`value_percent_rank`.
    """
    if not isinstance(counts.schema[value].dataType, (T.LongType, T.IntegerType)):
        return value_percent_rank(counts, value, materialize)
    hist = counts.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    hist = hist.select(
        value,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__below"),
        F.sum("__n").over(everyone).alias("__all"),
    ).select(
        value,
        F.when(F.col("__all") > 1, F.col("__below") / (F.col("__all") - 1))
         .otherwise(F.lit(0.0)).alias("pct_rank"),
    )
    return counts.join(F.broadcast(hist), [value], "left")


def value_percent_rank(rows: DataFrame, value: str, save: Callable[[DataFrame, str], DataFrame],
                       spread: str = "customer_id") -> DataFrame:
    """``percent_rank()`` over rows ordered by any value (NULL first), by ranges.

    The distinct values with their counts are dealt by range and written (``save``),
    so that a value's range is fixed. The driver adds up one count per range; a running
    sum inside each range gives the rows below a value. The ranks are joined back by
    value, and a value that very many rows share meets in no single task."""
    hist = save(rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(F.col(value).asc_nulls_first())
                .withColumn("part", F.spark_partition_id()), "value_ranges")
    total, starts = 0, []
    for r in hist.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        starts.append((r.part, total))
        total += r.n
    offsets = rows.sparkSession.createDataFrame(starts, "of long, start long")
    inside = Window.partitionBy("part").orderBy(F.col(value).asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    below = F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranks = hist.join(F.broadcast(offsets), F.col("part") == F.col("of")).select(
        F.col(value).alias("ranked"), F.col("n"), (below / F.lit(max(total - 1, 1))).alias("pct_rank"))
    ranks = ranks.withColumnRenamed("ranked", value)
    hot = skew.hot_of_counts(hist, value, "n")
    joined = skew.left_join(rows, ranks.drop("n"), value, hot, spread)
    return joined.withColumn("pct_rank", F.coalesce("pct_rank", F.lit(0.0)))  # NULL values are the lowest


def customer_segments(df: DataFrame, high: float = 0.90, medium: float = 0.50,
                      customer: str = "customer_id", order: str = "order_id",
                      orders_unique: bool = False) -> DataFrame:
    """customer_id, orders_total, pct_rank, customer_segment (High/Medium/Low)."""
    return rank_segments(orders_per_customer(df, customer, order, orders_unique), high, medium)


def rank_segments(counts: DataFrame, high: float = 0.90, medium: float = 0.50) -> DataFrame:
    """Segments from a table of order counts (read twice: cut it first if it is
    costly)."""
    ranked = customer_percent_rank(counts)
    return ranked.withColumn("customer_segment", segment_label("pct_rank", high, medium))


def with_segment(base: DataFrame, segments: DataFrame, customer: str = "customer_id", hot: Sequence[str] = (),
                 order: str = "order_id") -> DataFrame:
    """base LEFT JOIN segments: orders without a customer get a NULL segment. ``hot``:
    customers with very many orders (``skew.hot_of_counts``)."""
    return skew.left_join(base, segments.select(customer, "customer_segment"), customer, hot, order)
