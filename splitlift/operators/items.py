"""Nested order items: unnesting and the item -> order rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ORDER_ITEM


def explode_items(df: DataFrame, order: str = "order_id", items: str = "items") -> DataFrame:
    """One row per item; NULL or empty arrays keep one row with a NULL item."""
    return df.select(order, F.explode_outer(items).alias("item"))


def explode_garnish(item_rows: DataFrame) -> DataFrame:
    """One row per sub-item of each item; items without sub-items keep one row."""
    return item_rows.withColumn("garnish", F.explode_outer("item.garnishItems"))


def _amount(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _finish(value: Column, discount: Column, n_items: Column) -> list[Column]:
    return [
        F.round(value / F.lit(100), 2).alias("item_total_value_sum"),
        F.round(value / n_items / F.lit(100), 2).alias("item_total_value_avg"),
        F.round(discount / F.lit(100), 2).alias("total_discount"),
    ]


def with_item_metrics(df: DataFrame, items: str = "items") -> DataFrame:
    """Adds the three item metrics to every order row, in-row: no explode, no shuffle.

    With x = items (or [NULL] when NULL/empty) and u = distinct(x):
    value = sum of item values over u + sum of sub-item values over all of x,
    discount likewise (items: totalDiscount, sub-items: discount),
    average = value / size(u); amounts are cents, results in currency units.
    Identical items of one order therefore count once, while their sub-items
    count once per copy, exactly as grouping by (order, item) does.

    u is taken from the sorted array (elements that differ from the one before),
    so a basket of n items costs n log n. Valid per row, i.e. when ``order_id``
    is unique (the fact's gate)."""
    arr = F.col(items)
    filled = F.when(arr.isNotNull() & (F.size(arr) > 0), arr).otherwise(
        F.array(F.lit(None).cast(ORDER_ITEM)))
    # Each step is a column of its own, so that it is computed once per row.
    step = df.withColumn("__x", F.array_sort(filled))
    step = step.withColumn("__u", F.filter("__x", lambda it, i: (i == 0) | ~it.eqNullSafe(
        F.get(F.col("__x"), i - 1))))
    x, u, zero = F.col("__x"), F.col("__u"), F.lit(0.0)

    def sub_sum(field: str) -> Column:
        return F.aggregate(x, zero, lambda acc, it: acc + F.coalesce(
            F.aggregate(it["garnishItems"], zero, lambda a, g: a + _amount(g[field]["value"])), zero))

    def own_sum(field: str) -> Column:
        return F.aggregate(u, zero, lambda acc, it: acc + _amount(it[field]["value"]))

    value = own_sum("totalValue") + sub_sum("totalValue")
    discount = own_sum("totalDiscount") + sub_sum("discount")
    return step.select("*", *_finish(value, discount, F.size(u))).drop("__x", "__u")


def order_item_metrics(df: DataFrame, order: str = "order_id", items: str = "items") -> DataFrame:
    """order_id + item metrics, computed in-row."""
    return with_item_metrics(df.select(order, items), items).drop(items)


def order_item_metrics_grouped(df: DataFrame, order: str = "order_id",
                               items: str = "items") -> DataFrame:
    """Same result by double unnesting and two aggregates (kept as a check)."""
    rows = explode_garnish(explode_items(df, order, items))
    per_item = (rows.groupBy(order, "item")
                    .agg(F.sum(_amount(F.col("garnish.totalValue.value"))).alias("g_value"),
                         F.sum(_amount(F.col("garnish.discount.value"))).alias("g_discount"))
                    .select(order,
                            (_amount(F.col("item.totalValue.value")) + F.col("g_value")).alias("v"),
                            (_amount(F.col("item.totalDiscount.value")) + F.col("g_discount")).alias("d")))
    return per_item.groupBy(order).agg(
        F.round(F.sum("v") / F.lit(100), 2).alias("item_total_value_sum"),
        F.round(F.avg("v") / F.lit(100), 2).alias("item_total_value_avg"),
        F.round(F.sum("d") / F.lit(100), 2).alias("total_discount"),
    )
