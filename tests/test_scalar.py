import datetime as dt

import pytest

from splitlift.functions.scalar import (lift_pct, local_to_utc, parse_items, round_half_up,
                                        significance_flag, step_bucket)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_local_to_utc(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = [("2019-01-10T12:00:00", "America/Sao_Paulo"), ("2019-06-10 12:00:00", "America/Sao_Paulo"),
                ("2019-01-10T12:00:00", None), ("2019-01-10T12:00:00", "Mars/Olympus"),
                ("not a time", "UTC"), ("2019-01-10T12:00:00Z", "UTC")]
        df = spark.createDataFrame(rows, "t string, z string")
        got = [r.u for r in df.select(local_to_utc("t", "z").alias("u")).collect()]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert got[0] == dt.datetime(2019, 1, 10, 14, 0)    # summer time, UTC-2
    assert got[1] == dt.datetime(2019, 6, 10, 15, 0)    # UTC-3
    assert got[2] is None and got[3] is None and got[4] is None
    assert got[5] == dt.datetime(2019, 1, 10, 12, 0)


ZONES = {"-03:00": 3, "GMT-3": 3, "UTC-03:00": 3, "Z": 0, "+5": -5, "+05": -5, "+0530": -5.5, "UT+1": -1,
         "+18:00": -18, "-18": 18, "GMT+05:30": -5.5, "Etc/GMT+3": 3, "UTC": 0, "EST": 5, "-7:5": 7 + 5 / 60}


def test_offset_zones_convert_and_unknown_ones_do_not_fail(spark):
    bad = ["ROC", "Factory", "localtime", "+19", "+18:01", "+03:60", "utc", "", "+ 3", "Z\n", None]
    df = spark.createDataFrame([(z, "2024-03-10T00:00:00") for z in [*ZONES, *bad]], "z string, t string")
    got = {r.z: r.u for r in df.select("z", local_to_utc("t", "z").alias("u")).collect()}
    for zone, hours in ZONES.items():
        assert got[zone] == dt.datetime(2024, 3, 10) + dt.timedelta(hours=hours), zone
    assert all(got[z] is None for z in bad)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_step_bucket(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        vals = [None, "30.5", "30", "0", "40", "40.01", "60", "79.9", "80", "80.1", "abc", "1e3"]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
        got = [r.b for r in df.select("i", step_bucket("v").alias("b")).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert got == [100, 40, 30, 30, 40, 60, 60, 80, 80, 100, 100, 100]


def test_round_half_up(spark):
    df = spark.createDataFrame([("1.005",), ("2.675",), ("x",), (None,)], "v string")
    assert [r.r for r in df.select(round_half_up("v", 2).alias("r")).collect()] == [1.01, 2.68, None, None]


def test_parse_items_typed(spark):
    texts = ['[{"sequence": 1, "totalValue": {"value": "100", "currency": "BRL"}}]',
             '{"sequence": 2}', "not json", "", None, '[{"sequence": 1.5, "externalId": 7}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", parse_items("t").alias("p")).orderBy("i").collect()
    assert rows[0].p[0].totalValue.value == "100"
    assert len(rows[1].p) == 1 and rows[1].p[0].sequence == 2          # object -> one element
    assert rows[2].p is None and rows[3].p is None and rows[4].p is None
    assert rows[5].p[0].sequence is None and rows[5].p[0].externalId == "7"


def test_parse_items_lenient(spark):
    texts = ['[{"totalValue": {"value": "5"}}]', "bad", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", parse_items("t", lenient=True).alias("p")).orderBy("i").collect()
    assert rows[0].p[0].totalValue["value"] == "5"
    assert [len(r.p) for r in rows[1:]] == [0, 0, 0]


def test_lift_and_flag(spark):
    df = spark.createDataFrame([(1.1, 1.0), (1.0, 0.0), (1.0, None), (float("nan"), 1.0)],
                               "t double, c double")
    rows = df.select(lift_pct("t", "c").alias("l")).collect()
    assert rows[0].l == 10.0 and rows[1].l is None and rows[2].l is None
    flags = spark.createDataFrame([(0.01,), (0.05,), (float("nan"),), (None,)], "p double")
    assert [r.f for r in flags.select(significance_flag("p").alias("f")).collect()] == ["Yes", "No", "No", "No"]
