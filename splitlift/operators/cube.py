"""All period and overview reports from one pass over the base.

``customer_days`` sums the base by customer, arm, segment, city and day. That table is
written once; every report is a rollup of it:

- the twelve period reports are one grouping over (city, segment) x (day, week, month).
  The table is dealt by customer once; each row is put under its (at most six) keys in
  place, and a customer's rows under a key are added up where they are. What travels
  after that is one row per key and task, and counting a customer is adding 1.
- the overview tables and the per-user metrics are sums by customer.

A NULL customer's rows are as many as there are days, cities, segments and arms, and so
are those of a customer with a third of all orders: no key is hot after the first sum,
which combines map-side. Order ids must be unique (the gate proves it); otherwise use
the functions of ``metrics`` on the base. Both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import month_start_text, to_cents, week_start_text
from . import distinct, stats
from .metrics import GROUP, MONEY, money_mean, money_total, period_columns

CUSTOMER, DAY = "customer_id", "order_date"
GROUPINGS = {"city": "city_state", "segment": "customer_segment"}
PERIODS = {"daily": "order_date", "weekly": "week", "monthly": "month"}
COMBINATIONS = tuple((p, g) for p in PERIODS for g in GROUPINGS)
# Sums that a row of customer_days carries, with the names period_columns expects.
SUMS = ("n_rows", "total_orders", *(f"__{tag}_{part}" for tag in MONEY for part in "cn"))


def _sums() -> list[Column]:
    return [F.sum(name).alias(name) for name in SUMS]


def customer_days(base: DataFrame, group: str = GROUP, groupings: Sequence[str] = tuple(GROUPINGS)) -> DataFrame:
    """Rows, orders and money (cents, number of values) by customer, arm, segment, city
    and day; ``groupings``: those of them that reports will ask for."""
    money = [x for tag, column in MONEY.items() for x in (
        F.sum(to_cents(column)).alias(f"__{tag}_c"), F.count(column).alias(f"__{tag}_n"))]
    return base.groupBy(CUSTOMER, group, *[GROUPINGS[g] for g in groupings], DAY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("order_id").alias("total_orders"), *money)


def top_k(days: DataFrame, key: str = "city_state", k: int = 3) -> DataFrame:
    """The k keys with most rows of the base; ties by key."""
    return (days.groupBy(key).agg(F.sum("n_rows").alias("orders"))
            .orderBy(F.col("orders").desc(), F.col(key).asc()).limit(k))


def _period_text(period: str) -> Column:
    day = F.col(DAY)
    return {"daily": day.cast("string"), "weekly": week_start_text(day), "monthly": month_start_text(day)}[period]


def _under_keys(days: DataFrame, top: DataFrame | None, combinations: Sequence[tuple[str, str]], group: str
                ) -> DataFrame:
    """Rows of the test, once under each key (period, grouping, at, value) they count for."""
    rows = days.where(F.col(group).isNotNull())
    kept = F.lit(True)
    if top is not None:  # at most k rows
        rows = rows.join(F.broadcast(top.select("city_state", F.lit(True).alias("top"))), "city_state", "left")
        kept = F.coalesce("top", F.lit(False))
    keys = [(p, g, F.struct(F.lit(p).alias("period"), F.lit(g).alias("grouping"), _period_text(p).alias("at"),
                            F.col(GROUPINGS[g]).alias("value"))) for p, g in combinations]
    listed = F.array(*[F.when(kept, key) if g == "city" else key for p, g, key in keys])
    return (rows.withColumn("key", F.explode(F.filter(listed, lambda k: k.isNotNull())))
            .select(CUSTOMER, group, DAY, "key.*", *SUMS))


def period_cube(days: DataFrame, top: DataFrame | None = None,
                combinations: Sequence[tuple[str, str]] = COMBINATIONS, group: str = GROUP) -> DataFrame:
    """Counts and sums of the rows in the test by (period, grouping, at, value, arm).
    ``top``: the cities that take part in city reports; None for all."""
    keys = ["period", "grouping", "at", "value", group]
    dealt = _under_keys(days.repartition(CUSTOMER), top, combinations, group)
    each = dealt.groupBy(CUSTOMER, *keys).agg(*_sums())
    return each.groupBy(*keys).agg(F.count(CUSTOMER).alias("unique_consumers"), *_sums())


def day_bitmaps(days: DataFrame, numbers: DataFrame, top: DataFrame | None = None, group: str = GROUP) -> DataFrame:
    """Who ordered, as bitmaps by (grouping, value, arm, day): a store that later days
    are added to, and from which any coarser period is merged."""
    under = _under_keys(days, top, [("daily", g) for g in GROUPINGS], group)
    return distinct.bitmaps(under.join(numbers, CUSTOMER), ["grouping", "value", group, DAY])


def bitmap_cube(days: DataFrame, maps: DataFrame, top: DataFrame | None = None, group: str = GROUP) -> DataFrame:
    """:func:`period_cube` with distinct customers from stored day bitmaps: weeks and
    months merge those of their days, and customers are never exchanged again."""
    keys = ["period", "grouping", "at", "value", group]
    sums = _under_keys(days, top, COMBINATIONS, group).groupBy(*keys).agg(*_sums())
    by_period = [maps.withColumns({"period": F.lit(p), "at": _period_text(p)}) for p in PERIODS]
    counts = distinct.count(by_period[0].unionByName(by_period[1]).unionByName(by_period[2]), keys,
                            "unique_consumers")
    same = F.lit(True)
    for k in keys:
        same = same & sums[k].eqNullSafe(counts[k])
    return sums.join(counts, same, "left").select(
        *[sums[k] for k in keys], F.coalesce("unique_consumers", F.lit(0)).alias("unique_consumers"), *SUMS)


def period_metrics(cube: DataFrame, period: str, grouping: str, group: str = GROUP) -> DataFrame:
    """One period report ("daily", "city") in the columns of ``metrics.period_metrics``."""
    column = PERIODS[period]
    at = F.col("at").cast("date") if period == "daily" else F.col("at")
    rows = cube.where((F.col("period") == period) & (F.col("grouping") == grouping)).select(
        F.col("value").alias(GROUPINGS[grouping]), group, at.alias(column), "unique_consumers", *SUMS)
    return period_columns(rows, GROUPINGS[grouping], column, group)


def customer_totals(days: DataFrame, group: str = GROUP) -> DataFrame:
    """Sums by arm and customer: as many rows as customers."""
    return days.groupBy(group, CUSTOMER).agg(*_sums())


def overviews(totals: DataFrame, group: str = GROUP) -> Mapping[str, DataFrame]:
    """The five overview tables from the sums by customer."""
    by_group = totals.groupBy(group).agg(
        F.count(CUSTOMER).alias("unique_customers"), F.count(F.lit(1)).alias("n_customers"),
        F.avg("total_orders").alias("avg_orders_per_customer"), F.count("__rev_c").alias("n_spent"), *_sums())

    def amounts(digits: int | None) -> list[Column]:
        return [money_total(F.col("__rev_c"), digits).alias("total_revenue"),
                money_mean(F.col("__rev_c"), F.col("__rev_n"), digits).alias("avg_order_amount")]
    whole = totals.agg(F.coalesce(F.sum("total_orders"), F.lit(0)).alias("total_orders"),
                       F.count_distinct(CUSTOMER).alias("total_customers"),
                       F.sum("__rev_c").alias("__rev_c"), F.sum("__rev_n").alias("__rev_n"))
    return {
        "ab_distribution": by_group.select(group, "unique_customers", "total_orders"),
        "ab_overview": whole.select("total_orders", "total_customers", *amounts(2)),
        "ab_group_metrics": by_group.select(group, "unique_customers", "total_orders", *amounts(2)),
        "ab_retention": by_group.select(group, "unique_customers", "total_orders", *amounts(None)),
        "ab_orders_per_customer": by_group.select(
            group, "avg_orders_per_customer",
            money_mean(F.col("__rev_c"), F.col("n_spent"), None).alias("avg_revenue_per_customer")),
    }


def user_metrics(days: DataFrame, segment: str = "customer_segment", group: str = GROUP,
                 segments: Sequence[str] = stats.SEGMENTS) -> DataFrame:
    """``stats.user_metrics`` from the sums by customer and day."""
    rows = days.where(F.col(segment).isin(*segments) & F.col(CUSTOMER).isNotNull() & F.col(group).isNotNull())
    per_user = rows.groupBy(segment, CUSTOMER, group).agg(*_sums())
    return per_user.select(segment, CUSTOMER, group, F.col("total_orders").alias("orders_total"),
                           money_mean(F.col("__rev_c"), F.col("__rev_n"), None).alias("aov"))
