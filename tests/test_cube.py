"""Reports from the customer-day table equal those from the base, by every path."""
import random

import pytest
from pyspark.sql import functions as F

from splitlift.operators import cube, distinct, metrics, stats
from splitlift.plans import pipeline
from splitlift.plans.catalog import _base
from splitlift.sources.sinks import materialize

from conftest import SF_SMALL

SCHEMA = ("order_id string, customer_id string, abtest_group string, customer_segment string, city_state string, "
          "order_date date, week string, month string, order_total_amount double, total_discount double, "
          "item_total_value_sum double, item_total_value_avg double")


@pytest.fixture(scope="module")
def base(spark):
    return _base(spark, SF_SMALL).select(*pipeline.REPORT_COLUMNS).cache()


@pytest.fixture(scope="module")
def rough(spark):
    """NULL customers, arms, segments, days and amounts; a customer with a third of all."""
    rng, rows = random.Random(4), []
    for i in range(600):
        c = rng.choice([None, "hot", "hot", *(f"c{k}" for k in range(30))])
        day = rng.choice([None, *(f"2024-0{m}-{d:02d}" for m in (1, 2) for d in range(1, 29))])
        rows.append((str(i), c, None if c is None else rng.choice(["control", "target", None]),
                     rng.choice(["High", "Medium", None]), rng.choice(["a", "b", "c", "d", ""]), day,
                     rng.choice([None, 1.25, 7.0]), rng.choice([None, 0.5])))
    df = spark.createDataFrame(rows, "order_id string, customer_id string, abtest_group string, customer_segment "
                                     "string, city_state string, day string, amount double, discount double")
    day = F.to_date("day")
    return df.select(
        "order_id", "customer_id", "abtest_group", "customer_segment", "city_state", day.alias("order_date"),
        cube.week_start_text(day).alias("week"), cube.month_start_text(day).alias("month"),
        F.col("amount").alias("order_total_amount"), F.col("discount").alias("total_discount"),
        (F.col("amount") * 2).alias("item_total_value_sum"), F.col("amount").alias("item_total_value_avg")).cache()


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module", params=["base", "rough"])
def table(request):
    return request.getfixturevalue(request.param)


def test_all_reports_equal_those_from_the_base(spark, table):
    plain = pipeline.reports(table, save=materialize)
    fast = pipeline.reports_from_days(materialize(cube.customer_days(table), "days"), save=materialize)
    assert list(plain) == list(fast)
    for name in plain:
        if name in ("welch_test", "significance"):
            continue
        assert same(plain[name], fast[name]), name
    a, b = ({r.segment: r for r in x["welch_test"].collect()} for x in (plain, fast))
    for segment in a:
        for x, y in zip(a[segment][1:], b[segment][1:]):
            assert x == pytest.approx(y, nan_ok=True) if x is not None else y is None


def test_user_metrics(table):
    assert same(stats.user_metrics(table), cube.user_metrics(cube.customer_days(table)))


def test_bitmaps_give_the_same_cube(spark, table):
    days = materialize(cube.customer_days(table), "days")
    top = cube.top_k(days)
    numbers = distinct.dense_numbers(days, "customer_id", materialize)
    maps = cube.day_bitmaps(days, numbers, top)
    assert same(cube.period_cube(days, top), cube.bitmap_cube(days, maps, top))


def test_later_days_are_added_to_stored_bitmaps(spark, rough):
    days = materialize(cube.customer_days(rough.where("order_date is not null")), "days")
    numbers = distinct.dense_numbers(days, "customer_id", materialize)
    early, late = (cube.day_bitmaps(days.where(f"order_date {op} '2024-01-20'"), numbers) for op in ("<", ">="))
    assert same(cube.period_cube(days), cube.bitmap_cube(days, early.unionByName(late)))


def test_numbers_are_dense_and_counts_exact(spark):
    keys = spark.range(70_000).selectExpr("cast(id % 40000 as string) as k", "id").unionByName(
        spark.createDataFrame([(None, 1)], "k string, id long")).repartition(7)
    numbers = distinct.dense_numbers(keys, "k", materialize)
    got = numbers.agg(F.count("*"), F.count_distinct("number"), F.min("number"), F.max("number")).first()
    assert tuple(got) == (40_000, 40_000, 0, 39_999)
    rows = keys.join(numbers, "k", "left").selectExpr("id % 3 as g", "number", "k").cache()
    maps = distinct.bitmaps(rows, ["g"])
    want = rows.groupBy("g").agg(F.count_distinct("k").alias("n"))
    assert same(want, distinct.count(maps, ["g"], "n"))
    assert distinct.count(maps, [], "n").first().n == 40_000
    assert distinct.bitmaps(rows.limit(0), ["g"]).count() == 0


def test_plan_deals_customers_once_and_has_no_expand(spark, base):
    days = materialize(cube.customer_days(base), "days")
    top = materialize(cube.top_k(days), "top")
    plan = cube.period_cube(days, top)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "Expand" not in plan and "distinct" not in plan
    assert len(exchanges) == 2  # by customer, and the last sums by key
    assert "hashpartitioning(customer_id" in plan


def test_no_rows_of_the_test(spark, rough):
    days = cube.customer_days(rough.where("abtest_group is null"))
    assert cube.period_cube(days).count() == 0
    nothing = cube.customer_days(rough.limit(0))
    tables = cube.overviews(cube.customer_totals(nothing))
    assert same(metrics.ab_overview(rough.limit(0), True), tables["ab_overview"])
    assert tables["ab_distribution"].count() == 0
