"""Plan shape checks over the whole catalog."""

import __spark_entry__ as E
from splitlift.operators import metrics
from splitlift.plans import pipeline
from splitlift.plans.catalog import _base
from splitlift.sources import fixtures as fx

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_building_the_fact_runs_no_job_and_gathers_nothing(spark):
    raw = [f(spark, SF_SMALL) for f in (fx.fx_orders, fx.fx_consumers, fx.fx_merchants, fx.fx_abtest)]
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    plan = _plan(pipeline.build_fact(pipeline.RawInputs(*raw)))
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert "SinglePartition" not in plan and "GlobalLimit" not in plan


def test_dedup_carries_each_column_once(spark):
    plan = _plan(E.queries()["dedup_latest"](spark, SF_SMALL))
    partial = [line for line in plan.splitlines() if "partial_max" in line][0]
    assert partial.count("l_returnflag#") == 1 and "max_by" not in partial


def test_column_pruning_reaches_the_scan(spark):
    df = E.queries()["dq_report_lines"](spark, SF_SMALL)
    formatted = df._jdf.queryExecution().executedPlan().treeString()
    scan = [line for line in formatted.splitlines() if "FileScan parquet" in line][0]
    assert "l_orderkey" in scan and "l_linenumber" in scan
    assert "l_extendedprice" not in scan and "l_shipdate" not in scan


def test_semi_join_equals_inner_join(spark):
    base = _base(spark, SF_SMALL)
    top = metrics.top_k(base, "city_state", 3)
    semi = metrics.restrict_to(base, top)
    inner = base.join(top, "city_state", "inner").drop("orders")
    assert semi.count() == inner.count()
    assert semi.select("order_id").exceptAll(inner.select("order_id")).count() == 0


def test_one_arm_segment_has_no_test(spark):
    from splitlift.operators import stats
    rows = [(f"u{i}", "control", "High", str(i), float(i)) for i in range(6)]
    rows += [(f"v{i}", "control" if i % 2 else "target", "Low", f"x{i}", float(i)) for i in range(8)]
    base = spark.createDataFrame(rows, "customer_id string, abtest_group string, "
                                       "customer_segment string, order_id string, order_total_amount double")
    res = {r.segment: r for r in stats.welch_test(stats.welch_moments(stats.user_metrics(base))).collect()}
    assert res["High"].t_stat_orders is None and res["High"].p_value_aov is None
    assert res["Low"].t_stat_aov is not None
