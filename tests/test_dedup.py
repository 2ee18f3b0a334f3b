from pyspark.sql import Window
from pyspark.sql import functions as F

from splitlift.operators.clean import dedup_latest
from splitlift.sources.fixtures import table

from conftest import SF_SMALL


def test_latest_wins_nulls_oldest(spark):
    rows = [("a", "2020-01-01", 1.0), ("a", "2020-02-01", 2.0), ("a", None, 3.0),
            ("b", None, 5.0), ("c", "2020-01-01", 1.0), ("c", "2020-01-01", 1.0),
            ("d", "2020-01-01", 1.0), ("d", "2020-01-01", 9.0)]
    df = spark.createDataFrame(rows, "id string, ts string, amount double")
    got = {r.id: (r.ts, r.amount) for r in dedup_latest(df, ["id"], "ts").collect()}
    assert got == {"a": ("2020-02-01", 2.0), "b": (None, 5.0), "c": ("2020-01-01", 1.0),
                   "d": ("2020-01-01", 9.0)}


def test_hot_key_is_combined_map_side(spark):
    hot = spark.range(200_000).select(F.lit("hot").alias("id"), F.col("id").alias("v"))
    cold = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"))
    out = dedup_latest(hot.unionByName(cold), ["id"], "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert plan.count("Aggregate") >= 2            # partial + final
    assert dict((r.id, r.v) for r in out.collect())["hot"] == 199_999


def test_equals_row_number_on_lineitem(spark):
    li = table(spark, SF_SMALL, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    rest = [c for c in li.columns if c not in keys and c != "l_shipdate"]
    w = Window.partitionBy(*keys).orderBy(F.col("l_shipdate").desc_nulls_last(),
                                         *[F.col(c).desc_nulls_last() for c in rest])
    ref = li.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    got = dedup_latest(li, keys, "l_shipdate")
    assert got.count() == ref.count()
    assert got.exceptAll(ref).count() == 0


def test_columns_that_cannot_be_compared_come_along(spark):
    df = spark.createDataFrame([("a", 1, {"k": "old"}), ("a", 2, {"k": "new"})], "id string, ts int, m map<string,string>")
    assert [(r.id, r.ts, r.m) for r in dedup_latest(df, ["id"], "ts").collect()] == [("a", 2, {"k": "new"})]
    by_column = dedup_latest(df.drop("m"), ["id"], -F.col("ts"))
    assert [(r.id, r.ts) for r in by_column.collect()] == [("a", 1)]
