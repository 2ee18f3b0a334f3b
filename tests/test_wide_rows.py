"""Baskets are many times as long as the rest of an order: they are neither exchanged nor sorted."""
import json

import pytest
from pyspark.sql import functions as F

from splitlift.operators import clean, fact
from splitlift.plans import catalog, pipeline
from splitlift.sources import fixtures as fx

from conftest import SF_SMALL


@pytest.fixture()
def without_broadcasts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_raw_orders_are_written_out_last(spark, without_broadcasts):
    plan = _plan(clean.clean_orders(fx.fx_orders(spark, SF_SMALL)))
    above, joined, _ = plan.partition("SortMergeJoin [order_id")
    assert joined and "SortAggregate" in above
    assert "Exchange" not in above and "- Sort [" not in above  # the baskets' text stays where it is made


def _tables(spark, folder, lines, orders):
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                 "l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string, "
                                  "o_orderpriority string").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")
                                                                       ).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, "c1", 1, 1.0), (2, "c2", 1, 2.0)], "c_custkey long, c_name string, c_nationkey int, "
                          "c_acctbal double").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(1, "R")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    spark.createDataFrame([(7, "s", 1, 10.0), (8, "t", 1, 20.0)], "s_suppkey long, s_name string, s_nationkey int, "
                          "s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    return folder


LINES = [(6, 1, 8, 1, 30.0, 10.0, 0.1, 0.5), (6, 2, 7, 2, None, None, None, 0.5), (None, 3, 7, 1, 1.0, 1.0, 0.0, 0.0),
         (13, 4, 7, 1, 1.0, 2.5, 0.0, None), (13, 4, 7, 1, 1.0, 2.5, 0.0, None)]
ORDERS = [(6, 1, 5.0, "2024-01-02", "p"), (None, 2, 6.0, "2024-01-02", "p"), (13, None, 7.0, "2024-01-03", "p"),
          (13, 2, 8.0, "2024-01-03", "p"), (17, 9, 9.0, "2024-01-04", "p")]


def test_baskets_of_null_and_repeated_keys(spark, tmpdir_path):
    rows = fx.fx_orders(spark, _tables(spark, f"{tmpdir_path}/t", LINES, ORDERS)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.order_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"6": 1, None: 1, "13": 4, "17": 2}
    assert by[None][0]["items"] is None and all(r["items"] is None for r in by["17"])
    items = sorted(json.loads(by["6"][0]["items"]), key=lambda i: i["sequence"])
    assert [i["sequence"] for i in items] == [1, 1, 2] and items[0] == items[1]
    assert [g["totalValue"]["value"] for g in items[0]["garnishItems"]] == ["500", "50"]
    assert items[2]["garnishItems"] == [{"name": "extra", "discount": {"currency": "BRL"}, "quantity": 1.0, "sequence": 1,
                                         "totalValue": {"currency": "BRL"}}]
    assert by["6"][0].merchant_id == "7"
    assert all(len(json.loads(r["items"])) == 2 for r in by["13"])


def test_orders_without_baskets_are_the_same_orders(spark):
    raw = spark.createDataFrame(
        [("o", "c", "2024-01-01T00:00:00", "UTC", 1.0, "a", "[]"), ("o", "c", "2024-01-01T00:00:00", "UTC", 1.0, "a", "not"),
         ("o", "b", "2024-01-01T00:00:00", "UTC", 9.0, "z", "z"), (None, "b", None, "UTC", 2.0, None, None),
         (None, None, None, None, 3.0, "q", "[]")],
        "order_id string, customer_id string, order_created_at string, merchant_timezone string, "
        "order_total_amount double, origin_platform string, items string")
    for c in ("customer_name", "delivery_address_city", "delivery_address_external_id", "delivery_address_state",
              "merchant_id", "order_scheduled_date"):
        raw = raw.withColumn(c, F.lit("x"))
    raw = raw.select(*[c for c in raw.columns if c != "items"], "items")
    whole, slim = clean.clean_orders(raw), clean.clean_orders(raw.drop("items"))
    assert sorted(map(str, whole.drop("items").collect())) == sorted(map(str, slim.collect()))
    assert slim.count() == 2


def test_reports_take_metrics_through_the_joins_not_baskets(spark):
    base = catalog._base(spark, SF_SMALL)
    assert "items" not in base.columns
    want = pipeline.analysis_base(catalog._fact(spark, SF_SMALL)).select(*pipeline.REPORT_COLUMNS)
    got = base.select(*pipeline.REPORT_COLUMNS)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    for name in ("user_metrics", "top_cities", "top_city_orders", "base_with_segment", "significance"):
        assert "collect_list" not in _plan(catalog.QUERIES[name](spark, SF_SMALL))


def test_baskets_take_no_part_in_the_joins_of_the_fact(spark, without_broadcasts):
    plan = _plan(catalog.QUERIES["null_profile"](spark, SF_SMALL))
    above, joined, _ = plan.partition("LeftOuter")   # the last join
    assert joined and "[order_id" in above.splitlines()[-1]


def test_fact_of_null_ids_keeps_every_basket(spark, tmpdir_path):
    sf = _tables(spark, f"{tmpdir_path}/t", LINES, ORDERS)
    raw = fx.fx_orders(spark, sf).withColumn("items", F.coalesce("items", F.lit('[{"sequence": 9}]')))
    orders = clean.clean_orders(raw)
    dims = (catalog._consumers(spark, sf), catalog._merchants(spark, sf), fx.fx_abtest(spark, sf))
    plain, apart = fact.order_fact(orders, *dims), fact.order_fact(clean.narrow_orders(raw), *dims, baskets=orders)
    assert apart.columns == plain.columns
    rows = [sorted(map(str, f.collect())) for f in (plain, apart)]
    assert rows[0] == rows[1] and len(rows[0]) == 4 and all("sequence" in r for r in rows[0])
