"""Joins that build the wide order fact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ORDER_FACT_COLUMNS
from . import skew


def join_merchants(orders: DataFrame, merchants: DataFrame) -> DataFrame:
    """orders LEFT JOIN merchants USING (merchant_id). Which side is broadcast, if
    any, is left to the planner and AQE, which know the sides' bytes."""
    m = merchants.withColumnRenamed("created_at", "merchant_created_at")
    return orders.join(m, ["merchant_id"], "left")


def join_consumers(df: DataFrame, consumers: DataFrame) -> DataFrame:
    """LEFT JOIN consumers USING (customer_id). The consumer's name is kept as
    ``consumer_name`` next to the order's own."""
    c = (consumers.withColumnRenamed("customer_name", "consumer_name")
                  .withColumnRenamed("created_at", "consumer_created_at"))
    return df.join(c, ["customer_id"], "left")


def join_abtest(df: DataFrame, abtest: DataFrame) -> DataFrame:
    """LEFT JOIN assignment USING (customer_id); customers outside the test get
    a NULL ``abtest_group``."""
    ab = abtest.select("customer_id", F.col("is_target").alias("abtest_group"))
    return df.join(ab, ["customer_id"], "left")


def join_customers(df: DataFrame, consumers: DataFrame, abtest: DataFrame, hot: Sequence[str] = ()) -> DataFrame:
    """Both customer joins as one join of the orders.

    Consumers and assignment meet first, on the small side, so the orders are
    joined once. ``hot``: customers with very many orders, joined by broadcast; they and
    orders without a customer meet in no single task."""
    c = (consumers.withColumnRenamed("customer_name", "consumer_name")
                  .withColumnRenamed("created_at", "consumer_created_at"))
    ab = abtest.select("customer_id", F.col("is_target").alias("abtest_group"))
    return skew.left_join(df, c.join(ab, ["customer_id"], "full_outer"), "customer_id", hot)


def order_fact(orders: DataFrame, consumers: DataFrame, merchants: DataFrame, abtest: DataFrame,
               hot: Mapping[str, Sequence[str]] | None = None, baskets: DataFrame | None = None) -> DataFrame:
    """The 29-column order fact from the cleaned inputs. ``hot``: hot values of
    ``merchant_id`` and ``customer_id`` (``skew.hot_keys``). Orders may come without
    ``items`` and with columns of their own, which stay behind the others.

    ``baskets``: order ids, each once, with their items. ``orders`` are then the narrow
    ones (``clean.narrow_orders``), and the items, many times as long as the rest, stay
    out of the joins by merchant and customer: they are met by order id, where the dedup
    has left them in order."""
    hot = hot or {}
    if baskets is not None:
        taken = {*orders.columns, *consumers.columns, *merchants.columns, *ORDER_FACT_COLUMNS, "consumer_name"}
        of_order, basket = skew.fresh(taken, "of_order"), skew.fresh(taken, "basket")
        baskets = baskets.select(F.col("order_id").alias(of_order), F.col("items").alias(basket))
    m = merchants.withColumnRenamed("created_at", "merchant_created_at")
    joined = skew.left_join(orders, m, "merchant_id", hot.get("merchant_id", ()))
    joined = join_customers(joined, consumers, abtest, hot.get("customer_id", ()))
    derived = {
        "customer_name": F.coalesce(F.col("customer_name"), F.col("consumer_name")),
        "delivery_address_city": F.coalesce(F.col("delivery_address_city"), F.col("merchant_city")),
    }
    if baskets is not None:
        joined = joined.join(baskets, F.col("order_id") == F.col(of_order), "left")
        derived["items"] = F.coalesce("items", basket)
    joined = joined.withColumns(derived)
    more = [c for c in orders.columns if c not in ORDER_FACT_COLUMNS]
    return joined.select(*[c for c in ORDER_FACT_COLUMNS if c in joined.columns], *more)
