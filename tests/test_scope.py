"""Cut tables belong to a scope and go with it."""
import os

import pytest

from splitlift.plans import pipeline
from splitlift.plans.catalog import QUERIES, _fact
from splitlift.sources import files, scope
from splitlift.sources.sinks import materialize

from conftest import SF_SMALL


def left(spark):
    top = scope.root(spark).removeprefix("file:")
    return [n for n in os.listdir(top) if n.startswith(scope.PREFIX)] if os.path.isdir(top) else []


@pytest.fixture(autouse=True)
def clean(spark):
    scope.close_application(spark)
    yield
    scope.close_application(spark)


def test_cuts_go_with_their_scope(spark):
    with scope.Scope(spark):
        outer = materialize(spark.range(3), "outer")
        with scope.Scope(spark, "inner") as inner:
            df = materialize(spark.range(4), "inner")
            assert df.count() == 4 and files.exists(spark, inner.folder)
        assert not files.exists(spark, inner.folder) and outer.count() == 3
    assert left(spark) == []


def test_failure_closes_a_scope(spark):
    with pytest.raises(ValueError):
        with scope.Scope(spark):
            materialize(spark.range(3), "x")
            raise ValueError
    assert left(spark) == []


def test_cuts_outside_a_scope_belong_to_the_application(spark):
    df = materialize(spark.range(3), "x")
    assert df.count() == 3 and len(left(spark)) == 1
    scope.close_application(spark)
    assert left(spark) == []


def test_sweep_deletes_folders_of_ended_applications(spark):
    top = scope.root(spark).removeprefix("file:")
    for app in ("app-1", "app-2"):
        os.makedirs(f"{top}/{scope.PREFIX}{app}/run_x")
    materialize(spark.range(3), "mine")
    assert scope.sweep(spark, finished=["app-1", spark.sparkContext.applicationId]) == ["app-1"]
    assert scope.sweep(spark) == []  # app-2 is not idle for long
    assert scope.sweep(spark, idle_hours=-1) == ["app-2"]
    assert left(spark) == [scope.PREFIX + spark.sparkContext.applicationId]


def test_the_analysis_leaves_nothing(spark, tmpdir_path):
    fact = _fact(spark, SF_SMALL)
    with scope.Scope(spark):
        out = pipeline.run_analysis(fact)
        assert len(pipeline.write_reports(out, tmpdir_path)) == len(out)
    assert left(spark) == []
    assert spark.read.parquet(f"{tmpdir_path}/weekly_city_lift").count() > 0


def test_every_query_leaves_nothing(spark):
    for name, query in QUERIES.items():
        with scope.Scope(spark):
            query(spark, SF_SMALL).limit(1).collect()
        assert left(spark) == [], name
