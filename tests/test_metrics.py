import pytest
from pyspark.sql import functions as F

from splitlift.operators import lift, metrics
from splitlift.plans.catalog import _base

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def base(spark):
    return _base(spark, SF_SMALL).cache()


def test_groups_sum_to_overview(base):
    ov = metrics.ab_overview(base).first()
    groups = metrics.ab_group_metrics(base).collect()
    assert sum(r.total_orders for r in groups) == ov.total_orders
    assert sum(r.unique_customers for r in groups) == ov.total_customers   # one arm per customer
    assert round(sum(r.total_revenue for r in groups), 2) == ov.total_revenue


def test_orders_unique_shortcut_matches(base):
    a = metrics.period_metrics(base, "week", "customer_segment")
    b = metrics.period_metrics(base, "week", "customer_segment", orders_unique=True)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_top_k_ties_by_key(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "city_state string")
    assert [r.city_state for r in metrics.top_k(df, "city_state", 2).collect()] == ["c", "a"]


def test_lift_missing_arm_and_zero_control(spark):
    rows = [("w1", "x", "control", 2.0, 10.0, 5.0), ("w1", "x", "target", 3.0, 12.0, 4.0),
            ("w2", "x", "target", 1.0, 1.0, 1.0), ("w3", "x", "control", 0.0, 0.0, 0.0),
            ("w3", "x", "target", 1.0, 1.0, 1.0)]
    m = spark.createDataFrame(rows, "week string, city_state string, abtest_group string, "
                                    "avg_orders_per_consumer double, avg_revenue_per_consumer double, "
                                    "avg_aov double")
    for c in lift.PIVOT_METRICS[3:]:
        m = m.withColumn(c, F.lit(1.0))
    out = {r.week: r for r in lift.lift(m, "week", "city_state").collect()}
    assert out["w1"].orders_lift_pct == 50.0 and out["w1"].revenue_lift_pct == 20.0
    assert out["w1"].aov_lift_pct == -20.0
    assert out["w2"].control_avg_aov is None and out["w2"].orders_lift_pct is None
    assert out["w3"].orders_lift_pct is None


def test_restrict_is_broadcast_semi_join(base):
    top = metrics.top_k(base, "city_state", 3)
    plan = metrics.restrict_to(base, top)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Broadcast" in plan


def test_production_reports_equal_the_exact_ones(spark, base):
    from splitlift.plans import pipeline
    exact, fast = pipeline.reports(base), pipeline.reports(base, orders_unique=True)
    for name in ("ab_overview", "weekly_city_metrics", "daily_segment_lift", "monthly_city_lift", "significance"):
        assert exact[name].exceptAll(fast[name]).count() == 0 and fast[name].exceptAll(exact[name]).count() == 0
