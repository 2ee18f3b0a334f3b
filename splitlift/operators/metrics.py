"""A/B metrics: overview tables, period metrics, top-k restriction.

Money is aggregated as exact integer cents (long sums): the result does not
depend on row order or partitioning, partial sums stay cheap fixed-width
longs, and the 2-decimal rounding of the totals is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio, to_cents

GROUP = "abtest_group"

# Money columns of the base by the tag of their sums.
MONEY = {
    "rev": "order_total_amount",
    "disc": "total_discount",
    "item_sum": "item_total_value_sum",
    "item_avg": "item_total_value_avg",
}


def money_total(cents: Column, digits: int | None = 2) -> Column:
    v = cents / F.lit(100)
    return v if digits is None else F.round(v, digits)


def money_mean(cents: Column, n: Column, digits: int | None = 2) -> Column:
    v = ratio(cents, n) / F.lit(100)
    return v if digits is None else F.round(v, digits)


def _order_count(order: str, orders_unique: bool) -> Column:
    # With a key proven unique (the fact's gate), count == count distinct, and
    # the aggregate keeps a single distinct (no Expand of every row).
    return F.count(order) if orders_unique else F.count_distinct(order)


def ab_distribution(base: DataFrame, group: str = GROUP) -> DataFrame:
    """group -> distinct customers, orders (count, not distinct). NULL group kept."""
    return base.groupBy(group).agg(
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count("order_id").alias("total_orders"))


def ab_overview(base: DataFrame, orders_unique: bool = False) -> DataFrame:
    """One row: distinct orders, distinct customers, revenue, mean order value."""
    cents = to_cents("order_total_amount")
    return base.agg(
        _order_count("order_id", orders_unique).alias("total_orders"),
        F.count_distinct("customer_id").alias("total_customers"),
        F.sum(cents).alias("__c"), F.count("order_total_amount").alias("__n"),
    ).select("total_orders", "total_customers",
             money_total(F.col("__c")).alias("total_revenue"),
             money_mean(F.col("__c"), F.col("__n")).alias("avg_order_amount"))


def ab_group_metrics(base: DataFrame, group: str = GROUP, digits: int | None = 2) -> DataFrame:
    """group -> distinct customers, orders (count), revenue, mean order value.
    ``digits=None`` gives the unrounded variant (retention table)."""
    return base.groupBy(group).agg(
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count("order_id").alias("total_orders"),
        F.sum(to_cents("order_total_amount")).alias("__c"),
        F.count("order_total_amount").alias("__n"),
    ).select(group, "unique_customers", "total_orders",
             money_total(F.col("__c"), digits).alias("total_revenue"),
             money_mean(F.col("__c"), F.col("__n"), digits).alias("avg_order_amount"))


def ab_retention(base: DataFrame, group: str = GROUP) -> DataFrame:
    return ab_group_metrics(base, group, digits=None)


def ab_orders_per_customer(base: DataFrame, group: str = GROUP) -> DataFrame:
    """Mean orders and mean spend per customer, by group (two-level aggregate)."""
    per_customer = base.groupBy(group, "customer_id").agg(
        F.count("order_id").alias("customer_orders"),
        F.sum(to_cents("order_total_amount")).alias("__spent_cents"))
    return per_customer.groupBy(group).agg(
        F.avg("customer_orders").alias("avg_orders_per_customer"),
        F.sum("__spent_cents").alias("__c"), F.count("__spent_cents").alias("__n"),
    ).select(group, "avg_orders_per_customer",
             money_mean(F.col("__c"), F.col("__n"), None).alias("avg_revenue_per_customer"))


def top_k(df: DataFrame, key: str = "city_state", k: int = 3) -> DataFrame:
    """The k keys with most rows; ties broken by key (ascending)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("orders"))
              .orderBy(F.col("orders").desc(), F.col(key).asc())
              .limit(k))


def restrict_to(df: DataFrame, keys: DataFrame, key: str = "city_state") -> DataFrame:
    """Rows whose key is among ``keys`` (a top-k table: at most k rows, so the
    broadcast is bounded by k)."""
    return df.join(F.broadcast(keys.select(key)), [key], "left_semi")


def period_metrics(df: DataFrame, period: str, grouping: str, group: str = GROUP,
                   orders_unique: bool = False) -> DataFrame:
    """(grouping, group, period) -> eleven metrics.

    Rows with a NULL group stay in; reports filter them out.
    """
    aggs = [F.count_distinct("customer_id").alias("unique_consumers"),
            _order_count("order_id", orders_unique).alias("total_orders")]
    for tag, column in MONEY.items():
        aggs += [F.sum(to_cents(column)).alias(f"__{tag}_c"),
                 F.count(column).alias(f"__{tag}_n")]
    return period_columns(df.groupBy(grouping, group, period).agg(*aggs), grouping, period, group)


def period_columns(sums: DataFrame, grouping: str, period: str, group: str = GROUP) -> DataFrame:
    """The eleven metrics from counts (unique_consumers, total_orders) and, per money
    column, its cents and the number of values in it."""
    def c(name: str) -> Column:
        return F.col(name)

    return sums.select(
        grouping, group, period,
        c("unique_consumers"),
        money_total(c("__rev_c")).alias("total_revenue"),
        c("total_orders"),
        money_mean(c("__rev_c"), c("__rev_n")).alias("avg_aov"),
        money_total(c("__disc_c")).alias("total_discount"),
        money_mean(c("__disc_c"), c("__disc_n")).alias("avg_discount"),
        money_total(c("__item_sum_c")).alias("total_item_value"),
        money_mean(c("__item_sum_c"), c("__item_sum_n")).alias("avg_item_value_sum"),
        money_mean(c("__item_avg_c"), c("__item_avg_n")).alias("avg_item_value_avg"),
        F.round(ratio(c("total_orders"), c("unique_consumers")), 2).alias("avg_orders_per_consumer"),
        F.round(ratio(c("__rev_c"), c("unique_consumers") * F.lit(100)), 2)
         .alias("avg_revenue_per_consumer"),
    )


def in_test(df: DataFrame, group: str = GROUP) -> DataFrame:
    """Rows that belong to an arm of the test."""
    return df.filter(F.col(group).isNotNull())
