"""End-to-end plans: the ELT run that builds and saves the order fact, and the
analysis that turns a saved fact into the A/B reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession

from .. import schemas
from ..operators import clean, cube, fact, items, lift, metrics, periods, quality, segments, skew, stats
from ..sources import readers, sinks

# Columns of the fact the analysis never needs (personal data stays out of
# the cached base).
PERSONAL = ("customer_name", "customer_phone_area", "customer_phone_number")

JOIN_KEYS = ("merchant_id", "customer_id")
PERIODS, GROUPINGS = cube.PERIODS, cube.GROUPINGS

# The only columns the reports read: a narrow table, cheap to write and scan.
REPORT_COLUMNS = (
    "order_id", "customer_id", "abtest_group", "customer_segment", "city_state",
    "order_date", "week", "month", "order_total_amount", "total_discount",
    "item_total_value_sum", "item_total_value_avg",
)

Save = Callable[[DataFrame, str], DataFrame]


@dataclass
class RawInputs:
    orders: DataFrame
    consumers: DataFrame
    merchants: DataFrame
    abtest: DataFrame


def load_raw(spark: SparkSession, paths: Mapping[str, str], partitions: int | None = None
             ) -> RawInputs:
    """Read the four raw datasets (keys: orders, consumers, merchants, abtest)."""
    return RawInputs(
        orders=readers.load_dataset(spark, paths["orders"], schemas.ORDERS_RAW, partitions=partitions),
        consumers=readers.load_dataset(spark, paths["consumers"], schemas.CONSUMERS_RAW),
        merchants=readers.load_dataset(spark, paths["merchants"], schemas.MERCHANTS_RAW),
        abtest=readers.load_dataset(spark, paths["abtest"], schemas.ABTEST_RAW),
    )


def build_fact(raw: RawInputs, before: Observation | None = None, after: Observation | None = None,
               hot: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Clean the three raw datasets and join them with the assignment. ``before`` and
    ``after`` count the orders ahead of the joins and behind them; ``hot`` are hot
    values of the join keys."""
    orders = clean.clean_orders(raw.orders)
    if before is not None:
        orders = quality.watched(orders, "order_id", before)
    out = fact.order_fact(orders, clean.clean_consumers(raw.consumers), clean.clean_merchants(raw.merchants),
                          raw.abtest, hot)
    return out if after is None else quality.watched(out, "order_id", after, JOIN_KEYS)


def check_dimensions(raw: RawInputs) -> None:
    """Dimension keys must be unique, or the joins would multiply orders."""
    quality.require_unique(raw.consumers, "customer_id", "consumers")
    quality.require_unique(raw.merchants, "id", "merchants")
    quality.require_unique(raw.abtest, "customer_id", "abtest")


def run_elt(raw: RawInputs, target: str, run_date: str, fmt: str = "parquet") -> dict:
    """Check the dimensions, build the fact, write it as a new version of ``target``
    (a table when ``fmt="table"``, else files of that format), and commit that version
    if it passes the gate.

    The gate's counts are taken while the fact is written: order ids are unique after
    the dedup, and joins with unique keys keep them so. Only where these counts prove
    nothing is the written fact read for them. The report, kept with the version, tells
    the analysis that ids are unique, and the next run which merchants and customers are
    hot; the first run looks for those in the raw orders. A run that fails or is killed at any point leaves
    the old version, or the whole new one."""
    check_dimensions(raw)
    before, after = Observation(), Observation()
    spark = raw.orders.sparkSession
    last = readers.saved_report(spark, target, fmt) or {}
    hot = last.get("hot") or skew.hot_keys(raw.orders, JOIN_KEYS)

    def gate(written: DataFrame) -> dict:
        report = quality.observed_report(before, after)
        notes = {"counted_while_writing": report is not None, "run_date": run_date,
                 "hot": quality.observed_hot(after, JOIN_KEYS, skew.tasks_of(written))}
        return {**quality.require(report or quality.dq_report(written, "order_id")), **notes}
    return sinks.save_full(build_fact(raw, before, after, hot), target, fmt, gate)


def analysis_base(fact_df: DataFrame, high: float = 0.90, medium: float = 0.50,
                  orders_unique: bool = False, counts: DataFrame | None = None, hot: Sequence[str] = ()) -> DataFrame:
    """Fact + customer segment + item metrics + calendar columns. ``counts``: orders
    per customer, if they are at hand; ``hot``: customers with very many. The metrics
    come first, so that baskets nobody asks for take no part in the join; a fact without
    ``items`` has been measured before or needs no metrics."""
    if counts is None:
        counts = segments.orders_per_customer(fact_df, orders_unique=orders_unique)
    rows = items.with_item_metrics(fact_df) if "items" in fact_df.columns else fact_df
    base = segments.with_segment(rows.drop(*PERSONAL), segments.rank_segments(counts, high, medium), hot=hot)
    return periods.add_periods(base)


def period_report(base: DataFrame, period: str, grouping: str, top: DataFrame | None = None,
                  orders_unique: bool = False, save: Save | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics of the rows in the test, lift) for one period x grouping. With
    ``save``, the metrics are stored and the lift starts from what was stored."""
    rows = metrics.restrict_to(base, top, grouping) if top is not None else base
    m = metrics.in_test(metrics.period_metrics(rows, period, grouping, orders_unique=orders_unique))
    m = save(m, f"{grouping}_{period}") if save else m
    return m, lift.lift(m, period, grouping)


def reports(base: DataFrame, k: int = 3, orders_unique: bool = False, save: Save | None = None
            ) -> dict[str, DataFrame]:
    """All named reports of the analysis, in presentation order.

    Without ``save`` nothing runs here. With it, results that several reports are
    derived from (top cities, period metrics, the test) are stored once."""
    save = save or (lambda df, name: df)
    out: dict[str, DataFrame] = {
        "ab_distribution": metrics.ab_distribution(base).orderBy(metrics.GROUP),
        "ab_overview": metrics.ab_overview(base, orders_unique),
        "ab_group_metrics": metrics.ab_group_metrics(base).orderBy(metrics.GROUP),
        "ab_retention": metrics.ab_retention(base).orderBy(metrics.GROUP),
        "ab_orders_per_customer": metrics.ab_orders_per_customer(base).orderBy(metrics.GROUP),
    }
    top = save(metrics.top_k(base, "city_state", k), "top_cities")
    out["top_cities"] = top.orderBy(top.orders.desc(), "city_state")
    for pname, pcol in PERIODS.items():
        for gname, gcol in GROUPINGS.items():
            m, lf = period_report(base, pcol, gcol, top if gname == "city" else None, orders_unique, save)
            out[f"{pname}_{gname}_metrics"] = m.orderBy(gcol, pcol, metrics.GROUP)
            out[f"{pname}_{gname}_lift"] = lf.orderBy(gcol, pcol)
    test = save(stats.welch_test(stats.welch_moments(stats.user_metrics(base))), "welch_test")
    out["welch_test"] = test.orderBy("segment")
    out["significance"] = stats.significance(test).orderBy("segment")
    return out


def reports_from_days(days: DataFrame, k: int = 3, save: Save | None = None) -> dict[str, DataFrame]:
    """The reports of :func:`reports` from the base summed by customer and day
    (``cube.customer_days``): one job for the twelve period reports, one for the
    overview tables, one for the test."""
    save = save or (lambda df, name: df)
    out = {name: df if name == "ab_overview" else df.orderBy(metrics.GROUP)
           for name, df in cube.overviews(save(cube.customer_totals(days), "customer_totals")).items()}
    top = save(cube.top_k(days, "city_state", k), "top_cities")
    out["top_cities"] = top.orderBy(top.orders.desc(), "city_state")
    cells = save(cube.period_cube(days, top), "period_cube")
    for pname, pcol in PERIODS.items():
        for gname, gcol in GROUPINGS.items():
            m = cube.period_metrics(cells, pname, gname)
            out[f"{pname}_{gname}_metrics"] = m.orderBy(gcol, pcol, metrics.GROUP)
            out[f"{pname}_{gname}_lift"] = lift.lift(m, pcol, gcol).orderBy(gcol, pcol)
    test = save(stats.welch_test(stats.welch_moments(cube.user_metrics(days))), "welch_test")
    out["welch_test"] = test.orderBy("segment")
    out["significance"] = stats.significance(test).orderBy("segment")
    return out


def run_analysis(fact_df: DataFrame, export_dir: str | None = None, k: int = 3,
                 orders_unique: bool | None = None, run_date: str | None = None) -> dict[str, DataFrame]:
    """Reports from a saved fact.

    ``orders_unique``: whether order ids are known to be unique - the gate's report
    says so (``readers.saved_report``) - so that counts need no distinct; None finds out
    (one aggregate). Both give the same numbers.

    With unique ids, the base is read once and summed by customer and day; that table,
    a day's worth of orders per row, is written to the shared checkpoint folder, and all
    reports are rollups of it. Otherwise the base itself is reduced to the report
    columns and written once. A lost executor costs a re-read of files, which go when
    the scope that is open here is closed. The weekly reports are exported as CSV when
    asked."""
    if orders_unique is None:
        orders_unique = bool(quality.dq_report(fact_df.select("order_id"), "order_id").first().key_is_unique)

    def save(df: DataFrame, name: str) -> DataFrame:
        return sinks.materialize(df, f"report_{name}", run_date)
    counts = save(segments.orders_per_customer(fact_df, orders_unique=orders_unique), "orders_per_customer")
    hot = skew.hot_of_counts(counts, "customer_id", "orders_total")
    base = analysis_base(fact_df, counts=counts, hot=hot).select(*REPORT_COLUMNS)
    if orders_unique:
        out = reports_from_days(save(cube.customer_days(base), "customer_days"), k, save)
    else:
        out = reports(save(base, "base"), k, False, save)
    if export_dir:
        for name, keys in (("weekly_city_metrics", ("city_state", "week")),
                           ("weekly_segment_metrics", ("customer_segment", "week"))):
            sinks.export_report(out[name], f"{export_dir.rstrip('/')}/{name}", keys)
    return out


def write_reports(out: Mapping[str, DataFrame], path: str | None, fmt: str = "parquet",
                  parallel: int = 4) -> list[str]:
    """Write every report (``path/<name>``), submitting up to ``parallel``
    independent jobs at once: each report is a small aggregate over the same
    stored base, so concurrent jobs keep the executors busy. Returns the
    names in completion order."""
    def write(item: tuple[str, DataFrame]) -> str:
        name, df = item
        w = df.write.mode("overwrite").format(fmt)
        if path is None:
            w.save()
        else:
            w.save(f"{path.rstrip('/')}/{name}")
        return name
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return list(pool.map(write, out.items()))
