import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from splitlift.operators.segments import customer_percent_rank, customer_segments, orders_per_customer
from splitlift.plans.catalog import _fact

from conftest import SF_SMALL


def _window_rank(counts):
    return counts.withColumn("ref", F.percent_rank().over(Window.orderBy("orders_total")))


def test_histogram_equals_percent_rank(spark):
    counts = orders_per_customer(_fact(spark, SF_SMALL))
    got = customer_percent_rank(counts).join(_window_rank(counts), ["customer_id", "orders_total"])
    assert got.filter(F.col("pct_rank") != F.col("ref")).count() == 0
    assert got.count() == counts.where("customer_id is not null").count()


def test_ties_one_row_and_null_customer(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("c", "5"),
                                (None, "6")], "customer_id string, order_id string")
    seg = {r.customer_id: (r.pct_rank, r.customer_segment) for r in customer_segments(df).collect()}
    # counts: a=2, b=1, c=2, NULL=1 -> ranks 0, 0, 2/3, 2/3
    assert seg["b"] == (0.0, "Low") and seg[None] == (0.0, "Low")
    assert seg["a"] == (2 / 3, "Medium") and seg["c"] == (2 / 3, "Medium")
    one = spark.createDataFrame([("x", "1")], "customer_id string, order_id string")
    assert customer_segments(one).first().pct_rank == 0.0


def test_segments_partition_customers(spark):
    seg = customer_segments(_fact(spark, SF_SMALL))
    assert seg.count() == seg.select("customer_id").distinct().count()
    assert {r.customer_segment for r in seg.select("customer_segment").distinct().collect()} <= {
        "High", "Medium", "Low"}


def _ranked(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"customer_id string, spent {kind}")


def test_percent_rank_of_any_value(spark):
    rng = random.Random(3)
    rows = [(f"c{i}", rng.choice([None, 0.0, -0.0, 1.5, rng.uniform(-9, 9), float("nan"), float("inf")]))
            for i in range(400)] + [(None, 1.5)] * 200
    df = _ranked(spark, rows)
    got = customer_percent_rank(df, "spent")
    want = df.withColumn("pct_rank", F.percent_rank().over(Window.orderBy("spent")))
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_percent_rank_of_texts_and_small_tables(spark):
    df = _ranked(spark, [("a", "x"), ("b", "y"), ("c", "x"), ("d", None)], "string")
    assert {r.customer_id: r.pct_rank for r in customer_percent_rank(df, "spent").collect()} == {
        "a": 1 / 3, "b": 1.0, "c": 1 / 3, "d": 0.0}
    assert [r.pct_rank for r in customer_percent_rank(_ranked(spark, [("a", 2.0)]), "spent").collect()] == [0.0]
    assert customer_percent_rank(_ranked(spark, []), "spent").collect() == []


def test_a_million_values_meet_in_no_single_task(spark):
    df = spark.range(1_000_000).select(
        F.col("id").cast("string").alias("customer_id"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.xxhash64("id") / 1e12).alias("spent"))
    ranked = customer_percent_rank(df, "spent")
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()
    want = df.withColumn("ref", F.percent_rank().over(Window.orderBy("spent"))).select("customer_id", "ref")
    bad = ranked.join(want, "customer_id").where("abs(pct_rank - ref) > 1e-12").count()
    assert bad == 0 and ranked.count() == 1_000_000
