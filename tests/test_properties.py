"""Property-style checks: the JVM fast path + Arrow path equal the plain
Python rules on many random strings (seeded, so runs are repeatable)."""
import random

import pytest

from splitlift.functions.text import clean_text, fold_text, fold_text_strict, zero_pad

FRAGMENTS = ["a", "Z", "9", " ", "  ", "\t", "\n", "-", "_", "!", ".", "&", "&amp;", "&amp",
             "&copy;", "&lt;b", "é", "Ç", "ß", "ñ", "Ü", "ø", "ﬁ", "²", "™", "中", "São", "Straße",
             "x&y", "--", "O'Neil", " ", " "]


def _strings(n, seed):
    rnd = random.Random(seed)
    out = [None, ""]
    for _ in range(n):
        out.append("".join(rnd.choice(FRAGMENTS) for _ in range(rnd.randint(1, 12))))
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_two_paths_equal_python_on_random_text(spark, strict):
    values = _strings(600, seed=7 + strict)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.c for r in df.select("i", clean_text("v", strict=strict).alias("c")).orderBy("i").collect()]
    py = fold_text_strict if strict else fold_text
    assert got == [py(v) for v in values]


def test_zero_pad_equals_zfill_on_random_ids(spark):
    rnd = random.Random(11)
    values = [None, ""] + ["".join(rnd.choice("+-0123456789ab") for _ in range(rnd.randint(1, 10)))
                           for _ in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.p for r in df.select("i", zero_pad("v", 7).alias("p")).orderBy("i").collect()]
    assert got == [None if not v else v.zfill(7) for v in values]


def _random_items(rnd):
    def money(v):
        return None if v is None else {"value": v, "currency": "BRL"}
    amounts = ["100", "250", "0", "x", None, "1e2", "33"]
    pool = []
    for seq in range(1, 4):
        subs = rnd.choice([None, [], [None], [{"totalValue": money(rnd.choice(amounts)),
                                               "discount": money(rnd.choice(amounts))}]])
        pool.append({"sequence": seq, "totalValue": money(rnd.choice(amounts)),
                     "totalDiscount": money(rnd.choice(amounts)), "garnishItems": subs})
    kind = rnd.random()
    if kind < 0.1:
        return None
    if kind < 0.2:
        return []
    return [rnd.choice(pool + [None]) for _ in range(rnd.randint(1, 6))]   # repeats are likely


def test_item_rollup_forms_agree_on_random_baskets(spark):
    from splitlift.operators.items import order_item_metrics, order_item_metrics_grouped
    from splitlift.schemas import ITEMS
    rnd = random.Random(3)
    rows = [(str(i), _random_items(rnd)) for i in range(500)]
    df = spark.createDataFrame(rows, f"order_id string, items {ITEMS.simpleString()}")
    a, b = order_item_metrics(df), order_item_metrics_grouped(df)
    assert a.count() == b.count() == 500
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_dedup_equals_row_number_on_random_rows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from splitlift.operators.clean import dedup_latest
    rnd = random.Random(5)
    rows = [(rnd.randint(1, 40), rnd.choice([None, 1, 2, 3]), rnd.choice([None, "a", "b"]),
             rnd.choice([1.5, 2.5, None])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k int, ts int, s string, d double")
    w = Window.partitionBy("k").orderBy(*[F.col(c).desc_nulls_last() for c in ("ts", "s", "d")])
    ref = df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    got = dedup_latest(df, ["k"], "ts")
    assert got.count() == ref.count() == df.select("k").distinct().count()
    assert got.exceptAll(ref).count() == 0
