"""Refreshes that are ended between any two steps: readers see a whole old or new fact."""
import os
import threading

import pytest

from splitlift.operators.quality import DataQualityError
from splitlift.plans import pipeline
from splitlift.sources import fixtures as fx
from splitlift.sources import versioned as V
from splitlift.sources.readers import read_saved, saved_report

from conftest import SF_SMALL


class Killed(BaseException):
    """Ends a run where no handler of the code under test sees it, as a kill does."""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, tag, n=6):
    return spark.range(n).selectExpr(f"'{tag}' as tag", "id").repartition(3)


def whole(tag, n=6):
    return [(tag, i) for i in range(n)]


def check(df):
    return {"n_rows": df.count(), "note": "it's \\ \"quoted\""}


@pytest.fixture()
def target(spark, tmpdir_path, request):
    if request.param == "table":
        name = f"t_{os.path.basename(tmpdir_path).replace('-', '_')}".lower()
        yield name, "table"
    else:
        yield f"{tmpdir_path}/fact", "parquet"


def start(spark, target, fmt, kind):
    """An empty target, a plainly written one, or one that was refreshed before."""
    if kind == "plain":
        writer = frame(spark, "old").write
        writer.saveAsTable(target) if fmt == "table" else writer.parquet(target)
    elif kind == "versions":
        for tag in ("older", "old"):
            V.refresh(frame(spark, tag), target, check, fmt)


def stopped_at(monkeypatch, last):
    """Ends the run at the step of that name."""
    seen = []

    def step(name):
        seen.append(name)
        if name == last:
            raise Killed(name)
    monkeypatch.setattr(V, "_step", step)
    return seen


STEPS = ("recovered", "begun", "written", "checked", "set aside", "written", "rolled back data", "drafted", "committed",
         "dropped data", "none")


@pytest.mark.parametrize("target", ["files", "table"], indirect=True)
@pytest.mark.parametrize("kind", ["plain", "versions"])
def test_a_run_ended_between_any_two_steps(spark, target, kind, monkeypatch):
    name, fmt = target
    start(spark, name, fmt, kind)
    ended = set()
    for k, last in enumerate(STEPS):
        tag = f"new{k}"
        before = rows(read_saved(spark, name, fmt))
        seen = stopped_at(monkeypatch, last)
        try:
            V.refresh(frame(spark, tag), name, check, fmt)
        except Killed:
            ended.add(last)
        now = rows(read_saved(spark, name, fmt))
        assert now in (before, whole(tag)), seen
        assert (now == whole(tag)) == ("committed" in seen), seen
    assert now == whole(tag)
    assert saved_report(spark, name, fmt) == check(read_saved(spark, name, fmt))
    only_files, only_tables = {"rolled back data", "drafted"}, {"set aside"} if kind == "plain" else set()
    assert ended >= {"recovered", "begun", "written", "checked", "committed", "dropped data"}
    assert ended >= (only_tables if fmt == "table" else only_files)
    left = V.target_of(spark, name, fmt)
    if fmt == "table":
        assert len(left._versions()) == V.KEPT
    else:
        assert len([n for n in os.listdir(name) if n.startswith("_v")]) == V.KEPT
        assert all(states == {V.COMMITTED} for states in left._entries().values())


@pytest.mark.parametrize("target", ["files", "table"], indirect=True)
def test_a_first_run_that_dies_leaves_nothing_to_read(spark, target, monkeypatch):
    name, fmt = target
    stopped_at(monkeypatch, "written")
    with pytest.raises(Killed):
        V.refresh(frame(spark, "new"), name, check, fmt)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|UNABLE_TO_INFER|TABLE_OR_VIEW_NOT_FOUND"):
        read_saved(spark, name, fmt).collect()
    stopped_at(monkeypatch, None)
    V.refresh(frame(spark, "newer"), name, check, fmt)
    assert rows(read_saved(spark, name, fmt)) == whole("newer")


@pytest.mark.parametrize("target", ["files", "table"], indirect=True)
def test_failing_check_keeps_the_old_version(spark, target):
    name, fmt = target
    start(spark, name, fmt, "versions")

    def fails(df):
        raise DataQualityError("no")
    with pytest.raises(DataQualityError):
        V.refresh(frame(spark, "bad"), name, fails, fmt)
    assert rows(read_saved(spark, name, fmt)) == whole("old")
    assert V.target_of(spark, name, fmt).current() == 2


@pytest.mark.parametrize("target", ["files", "table"], indirect=True)
def test_a_reader_keeps_its_version_over_a_refresh(spark, target):
    name, fmt = target
    start(spark, name, fmt, "versions")
    to = V.target_of(spark, name, fmt)
    held = to.read(to.current())  # resolved, not yet read
    V.refresh(frame(spark, "new"), name, check, fmt)
    assert rows(held) == whole("old") and rows(read_saved(spark, name, fmt)) == whole("new")


@pytest.mark.parametrize("target", ["files", "table"], indirect=True)
def test_readers_beside_refreshes_see_whole_versions(spark, target):
    name, fmt = target
    start(spark, name, fmt, "versions")
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(rows(read_saved(spark, name, fmt)))
    reader = threading.Thread(target=read)
    reader.start()
    for k in range(3):
        V.refresh(frame(spark, f"new{k}"), name, check, fmt)
    stop.set()
    reader.join()
    assert seen and all(s in [whole("old"), *(whole(f"new{k}") for k in range(3))] for s in seen)


@pytest.mark.parametrize("target", ["files", "table"], indirect=True)
def test_a_second_writer_stops_the_first_ones_commit(spark, target):
    name, fmt = target
    start(spark, name, fmt, "versions")

    def second(df):
        V.refresh(frame(spark, "second"), name, check, fmt)
        return check(df)
    with pytest.raises(Exception):
        V.refresh(frame(spark, "first"), name, second, fmt)
    assert rows(read_saved(spark, name, fmt)) == whole("second")


def _inputs(spark):
    return pipeline.RawInputs(fx.fx_orders(spark, SF_SMALL), fx.fx_consumers(spark, SF_SMALL),
                              fx.fx_merchants(spark, SF_SMALL), fx.fx_abtest(spark, SF_SMALL))


def test_elt_killed_before_its_commit(spark, tmpdir_path, monkeypatch):
    target = f"{tmpdir_path}/fact"
    spark.createDataFrame([("old",)], "order_id string").write.parquet(target)
    seen = stopped_at(monkeypatch, "checked")
    with pytest.raises(Killed):
        pipeline.run_elt(_inputs(spark), target, run_date="2024-01-01")
    assert seen[-1] == "checked"
    assert [r.order_id for r in read_saved(spark, target).collect()] == ["old"]
    stopped_at(monkeypatch, None)
    report = pipeline.run_elt(_inputs(spark), target, run_date="2024-01-02")
    assert read_saved(spark, target).count() == report["n_rows"] == 1500
    assert saved_report(spark, target)["key_is_unique"]
