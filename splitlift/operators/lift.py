"""Target-versus-control lift from period metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import lift_pct

# Metrics carried side by side per arm, in output order.
PIVOT_METRICS = (
    "avg_orders_per_consumer", "avg_revenue_per_consumer", "avg_aov",
    "total_discount", "avg_discount", "total_item_value", "avg_item_value_sum",
    "avg_item_value_avg",
)

# (lift column, metric) pairs.
LIFTS = (
    ("orders_lift_pct", "avg_orders_per_consumer"),
    ("revenue_lift_pct", "avg_revenue_per_consumer"),
    ("aov_lift_pct", "avg_aov"),
)


def lift(metrics: DataFrame, period: str, grouping: str, group: str = "abtest_group",
         arms: Sequence[str] = ("control", "target"), digits: int = 2) -> DataFrame:
    """Pivot the arms into ``{arm}_{metric}`` columns and add the lifts.

    The arm values are fixed (no distinct-values job); an arm missing for a
    (period, grouping) leaves its columns and the lifts NULL. The first arm is
    the control, the second the target.
    """
    control, target = arms
    pivoted = (metrics.groupBy(period, grouping)
                      .pivot(group, list(arms))
                      .agg(*[F.first(m).alias(m) for m in PIVOT_METRICS]))
    return pivoted.withColumns({
        name: lift_pct(f"{target}_{metric}", f"{control}_{metric}", digits)
        for name, metric in LIFTS
    })
