
from splitlift.operators.items import (explode_garnish, explode_items, order_item_metrics,
                                       order_item_metrics_grouped)
from splitlift.schemas import ITEMS
from splitlift.sources.fixtures import fx_orders
from splitlift.functions.scalar import parse_items

from conftest import SF_SMALL


def _m(v):
    return {"value": v, "currency": "BRL"}


def _item(seq, value, discount, subs):
    return {"sequence": seq, "totalValue": _m(value), "totalDiscount": _m(discount),
            "garnishItems": subs}


def _sub(value, discount="0"):
    return {"totalValue": _m(value), "discount": _m(discount)}


def edge_orders(spark):
    same = _item(1, "1000", "100", [_sub("200", "10")])
    rows = [
        ("dup", [same, same]),                                       # identical items collapse
        ("nullitem", [_item(1, "500", None, None), None]),
        ("nullarr", None),
        ("empty", []),
        ("nullsub", [_item(1, "300", "0", [None, _sub("50")])]),
        ("text", [_item(1, "abc", "x", [_sub("n/a")]), _item(2, "100", "1", [])]),
    ]
    return spark.createDataFrame(rows, f"order_id string, items {ITEMS.simpleString()}")


def _collect(df):
    return {r.order_id: (r.item_total_value_sum, r.item_total_value_avg, r.total_discount)
            for r in df.collect()}


def test_in_row_equals_grouped(spark):
    df = edge_orders(spark)
    in_row, grouped = _collect(order_item_metrics(df)), _collect(order_item_metrics_grouped(df))
    assert in_row == grouped
    # item value once, its sub-item once per copy: (1000 + 200 + 200) / 100
    assert in_row["dup"] == (14.0, 14.0, 1.2)
    assert in_row["nullarr"] == (0.0, 0.0, 0.0) and in_row["empty"] == (0.0, 0.0, 0.0)
    assert in_row["nullitem"] == (5.0, 2.5, 0.0)
    assert in_row["text"] == (1.0, 0.5, 0.01)


def test_in_row_has_no_exchange(spark):
    plan = order_item_metrics(edge_orders(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_fixture_orders_two_forms_agree(spark):
    o = (fx_orders(spark, SF_SMALL).select("order_id", "items").distinct()
         .select("order_id", parse_items("items").alias("items")))
    a, b = order_item_metrics(o), order_item_metrics_grouped(o)
    assert a.count() == b.count() == o.count()
    assert a.exceptAll(b).count() == 0


def test_explode_keeps_empty(spark):
    rows = explode_garnish(explode_items(edge_orders(spark)))
    counts = {r.order_id: r["count"] for r in rows.groupBy("order_id").count().collect()}
    assert counts == {"dup": 2, "nullitem": 2, "nullarr": 1, "empty": 1, "nullsub": 2, "text": 2}


def test_a_basket_of_many_items_takes_seconds(spark):
    import time
    n = 8000
    df = spark.createDataFrame([("big", [_item(i % 5000, str(i % 5000), "1", [_sub("2", "1")]) for i in range(n)])],
                               f"order_id string, items {ITEMS.simpleString()}").repartition(1)
    began = time.time()
    got = _collect(order_item_metrics(df))
    assert time.time() - began < 20
    assert got == _collect(order_item_metrics_grouped(df))
