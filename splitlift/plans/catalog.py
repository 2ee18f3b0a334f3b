"""Query catalog: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query starts from the given parquet tables (through the raw-shaped
views of ``sources.fixtures``) and runs over all of their rows. Nested columns
are summarised into scalars so results can be compared with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import local_to_utc, parse_items, step_bucket
from ..functions.text import clean_text, zero_pad
from ..operators import clean, cube, fact, items, lift, metrics, periods, quality, segments, stats
from ..session import apply_library_conf
from ..sources import fixtures as fx
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]


def _n_items(col: str = "items") -> F.Column:
    return F.when(F.col(col).isNotNull(), F.size(col)).alias("n_items")


def _items_text(col: str = "items") -> F.Column:
    """All fields of all items as one text, items in sorted order."""
    def sub_item(g):
        return F.concat_ws("/", g["totalValue"]["value"], g["discount"]["value"])

    def item(it):
        return F.concat_ws(":", it["sequence"].cast("string"), it["externalId"],
                           it["quantity"].cast("long").cast("string"), it["totalValue"]["value"],
                           it["totalDiscount"]["value"], F.array_join(F.transform(it["garnishItems"], sub_item), "+"))
    return F.array_join(F.array_sort(F.transform(col, item)), ",").alias("items_text")


# ---- inputs -----------------------------------------------------------------
# The inputs below are lazy plans (no data is cached). Several queries share
# them, so each is built once per application, tables dir and ANSI mode (casts
# capture the mode when the plan is built).

_PLANS: dict[tuple, DataFrame] = {}


def _shared(kind: str, spark: SparkSession, sf: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, kind, sf, spark.conf.get("spark.sql.ansi.enabled", None))
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def _orders(spark, sf):
    return _shared("orders", spark, sf, lambda: clean.clean_orders(fx.fx_orders(spark, sf)))


def _slim_orders(spark, sf):
    """The cleaned orders without their baskets, for queries that look into none."""
    return _shared("slim_orders", spark, sf, lambda: clean.clean_orders(fx.fx_orders(spark, sf).drop("items")))


def _measured_orders(spark, sf):
    """The cleaned orders with the metrics of their baskets in place of the baskets: the
    metrics are in-row, and three numbers travel through the joins instead."""
    return _shared("measured_orders", spark, sf, lambda: items.with_item_metrics(_orders(spark, sf)).drop("items"))


def _consumers(spark, sf):
    return _shared("consumers", spark, sf, lambda: clean.clean_consumers(fx.fx_consumers(spark, sf)))


def _merchants(spark, sf):
    return _shared("merchants", spark, sf, lambda: clean.clean_merchants(fx.fx_merchants(spark, sf)))


def _fact_of(spark, sf, orders, baskets=None):
    return fact.order_fact(orders, _consumers(spark, sf), _merchants(spark, sf), fx.fx_abtest(spark, sf),
                           baskets=baskets)


def _fact(spark, sf):
    return _shared("fact", spark, sf, lambda: _fact_of(
        spark, sf, clean.narrow_orders(fx.fx_orders(spark, sf)), _orders(spark, sf)))


def _slim_fact(spark, sf):
    return _shared("slim_fact", spark, sf, lambda: _fact_of(spark, sf, _slim_orders(spark, sf)))


def _base_of(fact_df, slim_fact):
    return pipeline.analysis_base(fact_df, counts=segments.orders_per_customer(slim_fact))


def _base(spark, sf):
    return _shared("base", spark, sf, lambda: _base_of(_fact_of(spark, sf, _measured_orders(spark, sf)),
                                                       _slim_fact(spark, sf)))


def _slim_base(spark, sf):
    """The base for reports that need no item metrics."""
    return _shared("slim_base", spark, sf, lambda: _base_of(_slim_fact(spark, sf), _slim_fact(spark, sf)))


def _period_report(spark, sf, period, grouping):
    top = metrics.top_k(_slim_base(spark, sf), "city_state", 3) if grouping == "city" else None
    cells = cube.period_cube(cube.customer_days(_base(spark, sf), groupings=[grouping]), top, [(period, grouping)])
    return cube.period_metrics(cells, period, grouping)


# ---- text and scalar functions ------------------------------------------------

def q_clean_text(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", clean_text("text").alias("text_clean"))


def q_clean_text_strict(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", clean_text("text", strict=True).alias("text_clean"))


def q_clean_text_pages(spark, sf):
    pages = fx.table(spark, sf, "pages")
    return pages.select("page_id", clean_text("html").alias("text_clean"))


def q_pad_external_id(spark, sf):
    o = fx.fx_orders(spark, sf)
    return o.select("order_id", zero_pad("delivery_address_external_id", 7)
                    .alias("delivery_address_external_id"))


def q_order_utc(spark, sf):
    o = fx.fx_orders(spark, sf)
    return o.select("order_id", "merchant_timezone",
                    local_to_utc("order_created_at", "merchant_timezone").alias("order_created_at_utc"))


def q_parse_items(spark, sf):
    o = fx.fx_orders(spark, sf).select("order_id", parse_items("items").alias("items"))
    garnish = F.aggregate(F.col("items"), F.lit(0), lambda a, it: a + F.size(it["garnishItems"]))
    cents = F.aggregate(F.col("items"), F.lit(0).cast("long"),
                        lambda a, it: a + it["totalValue"]["value"].try_cast("long"))
    return o.select("order_id", _n_items(), garnish.alias("n_garnish"),
                    cents.alias("value_cents"),
                    F.array_max(F.transform("items", lambda it: it["sequence"])).alias("max_sequence"))


def q_ticket_bucket(spark, sf):
    m = fx.fx_merchants(spark, sf)
    return m.select(F.col("id").alias("merchant_id"), "average_ticket",
                    step_bucket("average_ticket").alias("ticket_bucket"))


# ---- cleaning -------------------------------------------------------------------

def q_clean_merchants(spark, sf):
    return _merchants(spark, sf)


def q_clean_consumers(spark, sf):
    return _consumers(spark, sf)


def q_clean_orders(spark, sf):
    o = _orders(spark, sf)
    return o.select(*[c for c in o.columns if c != "items"], _n_items(), _items_text())


def q_dedup_latest(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return clean.dedup_latest(li, ["l_orderkey", "l_linenumber"], "l_shipdate")


# ---- joins ------------------------------------------------------------------------

_JOIN_KEEP = ["order_id", "customer_id", "merchant_id"]


def q_join_merchants(spark, sf):
    j = fact.join_merchants(_slim_orders(spark, sf), _merchants(spark, sf))
    return j.select(*_JOIN_KEEP, "merchant_created_at", "enabled", "price_range", "average_ticket",
                    "minimum_order_value", "merchant_city", "merchant_state", "merchant_country")


def q_join_consumers(spark, sf):
    j = fact.join_consumers(_slim_orders(spark, sf), _consumers(spark, sf))
    return j.select(*_JOIN_KEEP, "customer_name", "consumer_name", "language",
                    "consumer_created_at", "active")


def q_join_abtest(spark, sf):
    j = fact.join_abtest(_slim_orders(spark, sf), fx.fx_abtest(spark, sf))
    return j.select(*_JOIN_KEEP, "abtest_group")


def q_order_fact(spark, sf):
    f = _fact(spark, sf)
    return f.select(*[c for c in f.columns if c != "items"], _n_items(), _items_text())


# ---- data quality -------------------------------------------------------------------

def q_dq_report(spark, sf):
    return quality.dq_report(_slim_fact(spark, sf), "order_id")


def q_dq_report_lines(spark, sf):
    return quality.dq_report(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def q_null_profile(spark, sf):
    return quality.null_profile(_fact(spark, sf))


# ---- segments -----------------------------------------------------------------------

def q_orders_per_customer(spark, sf):
    return segments.orders_per_customer(_slim_fact(spark, sf))


def q_customer_percent_rank(spark, sf):
    return segments.customer_percent_rank(segments.orders_per_customer(_slim_fact(spark, sf)))


def q_customer_segments(spark, sf):
    return segments.customer_segments(_slim_fact(spark, sf))


def q_base_with_segment(spark, sf):
    f = _slim_fact(spark, sf)
    b = segments.with_segment(f, segments.customer_segments(f))
    return b.select("order_id", "customer_id", "abtest_group", "customer_segment")


# ---- items ----------------------------------------------------------------------------

def q_explode_items(spark, sf):
    rows = items.explode_items(_orders(spark, sf))
    return rows.select("order_id",
                       F.col("item.sequence").alias("sequence"),
                       F.col("item.externalId").alias("external_id"),
                       F.col("item.quantity").alias("quantity"),
                       F.col("item.totalValue.value").alias("value"),
                       F.col("item.totalDiscount.value").alias("discount"),
                       F.when(F.col("item").isNotNull(), F.size("item.garnishItems")).alias("n_garnish"))


def q_explode_garnish(spark, sf):
    rows = items.explode_garnish(items.explode_items(_orders(spark, sf)))
    return rows.select("order_id",
                       F.col("item.sequence").alias("sequence"),
                       F.col("item.externalId").alias("external_id"),
                       F.col("garnish.totalValue.value").alias("garnish_value"),
                       F.col("garnish.discount.value").alias("garnish_discount"))


def q_order_item_metrics(spark, sf):
    return items.order_item_metrics(_orders(spark, sf))


# ---- periods and overview -----------------------------------------------------------------

def q_period_columns(spark, sf):
    b = periods.add_periods(_slim_fact(spark, sf))
    return b.select("order_id", "order_created_at_utc", "order_date", "week", "month", "city_state")


def q_ab_distribution(spark, sf):
    return metrics.ab_distribution(_slim_base(spark, sf))


def q_ab_overview(spark, sf):
    return metrics.ab_overview(_slim_base(spark, sf))


def q_ab_group_metrics(spark, sf):
    return metrics.ab_group_metrics(_slim_base(spark, sf))


def q_ab_retention(spark, sf):
    return metrics.ab_retention(_slim_base(spark, sf))


def q_ab_orders_per_customer(spark, sf):
    return metrics.ab_orders_per_customer(_slim_base(spark, sf))


def q_top_cities(spark, sf):
    return metrics.top_k(_slim_base(spark, sf), "city_state", 3)


def q_top_city_orders(spark, sf):
    b = _slim_base(spark, sf)
    r = metrics.restrict_to(b, metrics.top_k(b, "city_state", 3), "city_state")
    return r.select("order_id", "customer_id", "abtest_group", "city_state", "order_date",
                    "order_total_amount")


def _metrics_report(period: str, grouping: str) -> Query:
    return lambda spark, sf: _period_report(spark, sf, period, grouping)


def _lift_report(period: str, grouping: str) -> Query:
    return lambda spark, sf: lift.lift(_period_report(spark, sf, period, grouping), cube.PERIODS[period],
                                       cube.GROUPINGS[grouping])


# ---- statistics ----------------------------------------------------------------------------

def q_user_metrics(spark, sf):
    return stats.user_metrics(_slim_base(spark, sf))


def _rounded(df: DataFrame, columns: list[str], digits: int = 6,
             overrides: dict[str, int] | None = None) -> DataFrame:
    # Floating moments depend on summation order in the last bits (in any
    # engine); results are reported at 6 decimals (variances of money, which
    # are ~1e9 currency^2, at 2).
    overrides = overrides or {}
    return df.withColumns({c: F.round(c, overrides.get(c, digits)) for c in columns})


def _welch(spark, sf):
    return stats.welch_test(stats.welch_moments(stats.user_metrics(_slim_base(spark, sf))))


def q_welch_moments(spark, sf):
    m = stats.welch_moments(stats.user_metrics(_slim_base(spark, sf)))
    return _rounded(m, ["mean_orders", "var_orders", "mean_aov", "var_aov"], overrides={"var_aov": 2})


def q_welch_test(spark, sf):
    return _rounded(_welch(spark, sf), ["t_stat_orders", "p_value_orders", "t_stat_aov", "p_value_aov"])


def q_significance(spark, sf):
    return _rounded(stats.significance(_welch(spark, sf)), ["p_value_orders", "p_value_aov"])


def _catalog() -> dict[str, Query]:
    cat: dict[str, Query] = {
        "clean_text": q_clean_text,
        "clean_text_strict": q_clean_text_strict,
        "clean_text_pages": q_clean_text_pages,
        "pad_external_id": q_pad_external_id,
        "order_utc": q_order_utc,
        "parse_items": q_parse_items,
        "ticket_bucket": q_ticket_bucket,
        "clean_merchants": q_clean_merchants,
        "clean_consumers": q_clean_consumers,
        "clean_orders": q_clean_orders,
        "dedup_latest": q_dedup_latest,
        "join_merchants": q_join_merchants,
        "join_consumers": q_join_consumers,
        "join_abtest": q_join_abtest,
        "order_fact": q_order_fact,
        "dq_report": q_dq_report,
        "dq_report_lines": q_dq_report_lines,
        "null_profile": q_null_profile,
        "orders_per_customer": q_orders_per_customer,
        "customer_percent_rank": q_customer_percent_rank,
        "customer_segments": q_customer_segments,
        "base_with_segment": q_base_with_segment,
        "explode_items": q_explode_items,
        "explode_garnish": q_explode_garnish,
        "order_item_metrics": q_order_item_metrics,
        "period_columns": q_period_columns,
        "ab_distribution": q_ab_distribution,
        "ab_overview": q_ab_overview,
        "ab_group_metrics": q_ab_group_metrics,
        "ab_retention": q_ab_retention,
        "ab_orders_per_customer": q_ab_orders_per_customer,
        "top_cities": q_top_cities,
        "top_city_orders": q_top_city_orders,
    }
    for period, grouping in cube.COMBINATIONS:
        cat[f"{period}_{grouping}_metrics"] = _metrics_report(period, grouping)
        cat[f"{period}_{grouping}_lift"] = _lift_report(period, grouping)
    cat.update({
        "user_metrics": q_user_metrics,
        "welch_moments": q_welch_moments,
        "welch_test": q_welch_test,
        "significance": q_significance,
    })
    return cat


def _with_conf(q: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_library_conf(spark)
        return q(spark, sf_dir)
    run.__name__ = getattr(q, "__name__", "query")
    run.__doc__ = q.__doc__
    return run


QUERIES: dict[str, Query] = {name: _with_conf(q) for name, q in _catalog().items()}
