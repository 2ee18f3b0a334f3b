import math
import statistics

import pytest

from splitlift.functions.tdist import t_two_sided_p
from splitlift.operators import stats


def test_t_distribution_table_values():
    assert abs(t_two_sided_p(2.2281, 10) - 0.05) < 1e-4
    assert abs(t_two_sided_p(12.706, 1) - 0.05) < 1e-4
    assert abs(t_two_sided_p(1.959964, 1e9) - 0.05) < 1e-6
    assert t_two_sided_p(0.0, 5) == 1.0
    assert t_two_sided_p(None, 5) is None and t_two_sided_p(1.0, float("nan")) is None


def _welch_py(a, b):
    va, vb = statistics.variance(a), statistics.variance(b)
    qa, qb = va / len(a), vb / len(b)
    t = (statistics.mean(a) - statistics.mean(b)) / math.sqrt(qa + qb)
    nu = (qa + qb) ** 2 / (qa ** 2 / (len(a) - 1) + qb ** 2 / (len(b) - 1))
    return t, t_two_sided_p(t, nu)


def _base_rows():
    rows = []
    # segment High: control users 1..6 with k orders of 10*k; target users with k+1 orders
    oid = 0
    for seg in ("High", "Low"):
        for arm, extra in (("control", 0), ("target", 1)):
            for u in range(1, 7):
                for _ in range(u + extra + (u % 2 if seg == "Low" else 0)):
                    oid += 1
                    rows.append((f"{seg}-{arm}-{u}", arm, seg, str(oid), 10.0 * u + oid % 3))
    rows.append(("lonely", "control", "Medium", "x1", 5.0))
    rows.append(("lonely2", "target", "Medium", "x2", 7.0))
    rows.append((None, "control", "High", "x3", 1.0))            # no customer: ignored
    rows.append(("nogroup", None, "High", "x4", 1.0))            # no arm: ignored
    return rows


def test_welch_matches_python(spark):
    base = spark.createDataFrame(_base_rows(), "customer_id string, abtest_group string, "
                                 "customer_segment string, order_id string, order_total_amount double")
    users = stats.user_metrics(base)
    res = {r.segment: r for r in stats.welch_test(stats.welch_moments(users)).collect()}
    pu = users.collect()
    for seg in ("High", "Low"):
        for metric, tag in (("orders_total", "orders"), ("aov", "aov")):
            c = [getattr(r, metric) for r in pu if r.customer_segment == seg and r.abtest_group == "control"]
            t = [getattr(r, metric) for r in pu if r.customer_segment == seg and r.abtest_group == "target"]
            t_ref, p_ref = _welch_py(c, t)
            assert res[seg][f"t_stat_{tag}"] == pytest.approx(t_ref, rel=1e-9)
            assert res[seg][f"p_value_{tag}"] == pytest.approx(p_ref, rel=1e-9)
    # one user per arm: no test
    assert res["Medium"].t_stat_orders is None and res["Medium"].p_value_orders is None
    sig = {r.segment: r for r in stats.significance(stats.welch_test(stats.welch_moments(users))).collect()}
    assert sig["Medium"].orders_significant == "No"


COLUMNS = ("customer_id string, abtest_group string, customer_segment string, order_id string, "
           "order_total_amount double")


def _tested(spark, rows):
    base = spark.createDataFrame(rows, COLUMNS)
    return {r.segment: r for r in stats.welch_test(stats.welch_moments(stats.user_metrics(base))).collect()}


def test_zero_variances(spark):
    same = [(f"u{i}", "control" if i % 2 else "target", "High", str(i), 10.0) for i in range(10)]
    apart = [(f"v{i}", "control" if i % 2 else "target", "Low", f"l{i}", 10.0 if i % 2 else 12.0) for i in range(10)]
    got = _tested(spark, same + apart)
    assert got["High"].t_stat_aov is None and got["High"].p_value_aov is None      # equal means
    assert got["Low"].t_stat_aov == float("-inf") and got["Low"].p_value_aov == 0.0
    assert got["Low"].t_stat_orders is None


def test_every_segment_has_a_row(spark):
    got = _tested(spark, [("u", "control", "High", "1", 1.0)])
    assert set(got) == {"High", "Medium", "Low"}
    assert got["Low"].t_stat_orders is None and got["Low"].p_value_aov is None


def test_p_values_at_many_degrees_of_freedom():
    for nu in (1e6, 1e8, 1e10):
        for t in (0.01, 0.5, 2.0, 5.0):
            assert abs(t_two_sided_p(t, nu) - math.erfc(t / math.sqrt(2))) < 1e-6


def test_a_fraction_that_does_not_converge_raises(monkeypatch):
    from splitlift.functions import tdist
    monkeypatch.setattr(tdist, "_MAX_TERMS", 2)
    with pytest.raises(ArithmeticError):
        t_two_sided_p(2.0, 7.0)


def test_no_driver_collect_in_plan(spark):
    base = spark.createDataFrame(_base_rows(), "customer_id string, abtest_group string, "
                                 "customer_segment string, order_id string, order_total_amount double")
    plan = stats.welch_test(stats.welch_moments(stats.user_metrics(base)))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" in plan
