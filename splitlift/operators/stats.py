"""Welch t-tests of target versus control per customer segment.

Distributed form: per-user metrics (one aggregate) -> per (segment, arm)
moments n / mean / sample variance (one aggregate, merge-stable variance) ->
t and Welch-Satterthwaite degrees of freedom as column expressions -> p from
a tiny Arrow UDF over one row per segment. No row ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio, significance_flag, to_cents
from ..functions.tdist import t_two_sided_p_udf

SEGMENTS = ("High", "Medium", "Low")
# (metric column in user_metrics, suffix used in the outputs)
TESTED = (("orders_total", "orders"), ("aov", "aov"))


def user_metrics(base: DataFrame, segment: str = "customer_segment", group: str = "abtest_group",
                 segments: Sequence[str] = SEGMENTS) -> DataFrame:
    """(segment, customer, arm) -> orders and mean order value of that user.

    Users with a NULL customer or arm are left out (they belong to no arm).
    """
    rows = base.filter(F.col(segment).isin(*segments)
                       & F.col("customer_id").isNotNull() & F.col(group).isNotNull())
    per_user = rows.groupBy(segment, "customer_id", group).agg(
        F.count("order_id").alias("orders_total"),
        F.sum(to_cents("order_total_amount")).alias("__c"),
        F.count("order_total_amount").alias("__n"))
    return per_user.select(segment, "customer_id", group, "orders_total",
                           (ratio(F.col("__c"), F.col("__n")) / F.lit(100)).alias("aov"))


def welch_moments(users: DataFrame, segment: str = "customer_segment",
                  group: str = "abtest_group") -> DataFrame:
    """(segment, arm) -> n, mean, var_samp of each tested metric."""
    aggs = []
    for column, tag in TESTED:
        aggs += [F.count(column).alias(f"n_{tag}"), F.avg(column).alias(f"mean_{tag}"),
                 F.var_samp(column).alias(f"var_{tag}")]
    return users.groupBy(segment, group).agg(*aggs)


def _welch(mc: Column, vc: Column, nc: Column, mt: Column, vt: Column, nt: Column
           ) -> tuple[Column, Column]:
    """t = (mean_c - mean_t) / sqrt(v_c/n_c + v_t/n_t); Welch df. NULL when an arm
    has fewer than two users. With both variances zero, t is infinite (p = 0) if
    the means differ and undefined (NULL) if they are equal."""
    qc, qt = vc / nc, vt / nt
    se2 = qc + qt
    enough = (nc >= 2) & (nt >= 2)
    ok = enough & (se2 > 0)
    t = (F.when(ok, (mc - mt) / F.sqrt(se2))
         .when(enough & (mc > mt), float("inf")).when(enough & (mc < mt), float("-inf")))
    nu = F.when(ok, se2 * se2 / (qc * qc / (nc - 1) + qt * qt / (nt - 1))).when(enough, 1.0)
    return t, nu


def welch_test(moments: DataFrame, segment: str = "customer_segment", group: str = "abtest_group",
               arms: Sequence[str] = ("control", "target"),
               segments: Sequence[str] = SEGMENTS) -> DataFrame:
    """segment -> t statistic and two-sided p for orders and order value
    (control minus target). Every segment has a row, NULL where it has no users."""
    control, target = arms
    stats = [f"{s}_{tag}" for _, tag in TESTED for s in ("n", "mean", "var")]
    side_by_side = moments.groupBy(segment).agg(*[
        F.max(F.when(F.col(group) == arm, F.col(s))).alias(f"{arm}__{s}")
        for arm in (control, target) for s in stats])
    every = moments.sparkSession.createDataFrame([(s,) for s in segments], f"`{segment}` string")
    side_by_side = every.join(side_by_side, segment, "left")
    cols: dict[str, Column] = {}
    for _, tag in TESTED:
        def arm_col(arm: str, stat: str) -> Column:
            return F.col(f"{arm}__{stat}_{tag}")
        t, nu = _welch(arm_col(control, "mean"), arm_col(control, "var"), arm_col(control, "n"),
                       arm_col(target, "mean"), arm_col(target, "var"), arm_col(target, "n"))
        cols[f"t_stat_{tag}"] = t
        cols[f"df_{tag}"] = nu
    with_t = side_by_side.select(segment, *[v.alias(k) for k, v in cols.items()])
    return with_t.select(
        F.col(segment).alias("segment"),
        *[x for _, tag in TESTED for x in (
            F.col(f"t_stat_{tag}"),
            t_two_sided_p_udf(F.col(f"t_stat_{tag}"), F.col(f"df_{tag}")).alias(f"p_value_{tag}"))])


def significance(test: DataFrame, alpha: float = 0.05) -> DataFrame:
    """segment, p values and Yes/No flags at ``alpha``."""
    return test.select(
        "segment",
        "p_value_orders", significance_flag("p_value_orders", alpha).alias("orders_significant"),
        "p_value_aov", significance_flag("p_value_aov", alpha).alias("aov_significant"))
