"""Every catalog query against its SQL oracle (DuckDB) on the smallest tables."""
import datetime as dt
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from splitlift.plans.catalog import QUERIES

from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem documents pages".split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    o_cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(o_cols)
    assert _rows(df.columns, df.collect()) == _rows(o_cols, cur.fetchall())
    # no row-at-a-time Python anywhere in the catalog
    assert "BatchEvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "aov_lift_pct" in df.columns


@pytest.mark.parametrize("name", ["order_fact", "weekly_city_lift", "welch_test", "clean_text"])
def test_ansi_off_gives_same_rows(spark, name):
    on = E.queries()[name](spark, SF_SMALL).collect()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        off = E.queries()[name](spark, SF_SMALL).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert Counter(map(tuple, on)) == Counter(map(tuple, off))
