import glob
import io
import os
import tarfile

import pytest

from splitlift import schemas
from splitlift.operators.items import order_item_metrics
from splitlift.plans import pipeline
from splitlift.plans.catalog import _fact
from splitlift.sources import fixtures as fx
from splitlift.sources.readers import detect_format, load_dataset, read_archive_csv, read_saved, saved_report
from splitlift.sources.sinks import export_report, materialize

from conftest import SF_SMALL


def _tar(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_detect_format():
    assert detect_format("s3://b/k/ORDER.JSON.GZ") == "json"
    assert detect_format("/x/a.csv") == "csv" and detect_format("/x/a.csv.gz") == "csv"
    assert detect_format("/x/a.parquet") == "parquet" and detect_format("/x/a.tgz") == "archive"
    with pytest.raises(ValueError):
        detect_format("/x/a.xlsx")


def test_archive_skips_appledouble_and_reads_latin1(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "ab.tar.gz")
    body = "customer_id,is_target\n1,control\n2,target\n3,S\xe3o\n".encode("latin-1")
    _tar(path, [("dir/._ab.csv", b"\x00\x05junk"), ("dir/readme.txt", b"x"), ("dir/ab.csv", body)])
    df = read_archive_csv(spark, path, schemas.ABTEST_RAW)
    assert sorted(tuple(r) for r in df.collect()) == [("1", "control"), ("2", "target"), ("3", "São")]


def test_archive_without_csv_fails(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "none.tar.gz")
    _tar(path, [("._x.csv", b"a"), ("x.txt", b"b")])
    with pytest.raises(Exception, match="no CSV member"):
        read_archive_csv(spark, path, schemas.ABTEST_RAW).collect()


AB = "customer_id,is_target\n"


def test_every_csv_member_of_many_archives(spark, tmpdir_path):
    for a in range(3):
        _tar(f"{tmpdir_path}/x{a}.tar.gz", [(f"m{k}.csv", (AB + f"{a}-{k},control\n").encode()) for k in range(3)])
    every = read_archive_csv(spark, f"{tmpdir_path}/*.tar.gz", schemas.ABTEST_RAW, every=True)
    assert sorted(r.customer_id for r in every.collect()) == [f"{a}-{k}" for a in range(3) for k in range(3)]
    first = read_archive_csv(spark, f"{tmpdir_path}/*.tar.gz", schemas.ABTEST_RAW)
    assert sorted(r.customer_id for r in first.collect()) == ["0-0", "1-0", "2-0"]


def test_a_member_has_one_encoding(spark, tmpdir_path):
    utf8 = (AB + "é,control\n").encode()
    latin = AB.encode() + "Ã©".encode("latin-1") + b",control\n" + b"x" * 9 + b",control\nS\xe3o,target\n"
    _tar(f"{tmpdir_path}/x.tar.gz", [("a.csv", utf8), ("b.csv", latin)])
    got = [r.customer_id for r in read_archive_csv(spark, f"{tmpdir_path}/x.tar.gz", schemas.ABTEST_RAW, True).collect()]
    assert sorted(got) == sorted(["é", "Ã©", "x" * 9, "São"])  # the first of b is valid UTF-8 by itself


@pytest.mark.parametrize("suffix", [".tar.gz", ".tgz"])
def test_line_ends_and_quotes_pass_through(spark, tmpdir_path, suffix):
    body = b'is_target,customer_id\r\n"a\nb","1 ""x"""\r\n\r\ncontrol,\n"\r",3'
    _tar(f"{tmpdir_path}/x{suffix}", [("skip.bin", bytes(range(256)) * 50), ("a.CSV", body)])
    got = read_archive_csv(spark, f"{tmpdir_path}/x{suffix}", schemas.ABTEST_RAW).collect()
    assert sorted((r.customer_id or "", r.is_target) for r in got) == [("", "control"), ('1 "x"', "a\nb"), ("3", "\r")]


def test_an_archive_passes_in_pieces(tmpdir_path):
    """A task holds some pieces and rows at a time, whatever the archive's size is."""
    import tracemalloc

    import pyarrow as pa
    from splitlift.sources import readers
    body = AB.encode() + b"".join(b"%d,control\n" % i for i in range(600_000))
    path = f"{tmpdir_path}/x.tar"
    with tarfile.open(path, "w") as tar:
        info = tarfile.TarInfo("a.csv")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))

    def batches():
        with open(path, "rb") as f:
            while lines := f.readlines(1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(["x"] * len(lines)), pa.array(lines, pa.binary())],
                                                 names=["path", "part"])
    tracemalloc.start()
    n = sum(b.num_rows for b in readers._archive_rows(["customer_id"], False, 1000)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600_000 and peak < len(body) * 0.7


def test_raw_files_round_trip_through_elt(spark, tmpdir_path):
    d = tmpdir_path
    fx.fx_orders(spark, SF_SMALL).write.option("compression", "gzip").json(f"{d}/orders.json.gz")
    for name, df in (("consumers", fx.fx_consumers(spark, SF_SMALL)),
                     ("merchants", fx.fx_merchants(spark, SF_SMALL))):
        df.write.option("header", True).option("compression", "gzip").csv(f"{d}/{name}.csv.gz")
    ab = fx.fx_abtest(spark, SF_SMALL).toPandas()            # small test fixture only
    _tar(f"{d}/ab.tar.gz", [("._ab.csv", b"junk"), ("ab.csv", ab.to_csv(index=False).encode())])
    raw = pipeline.load_raw(spark, {"orders": f"{d}/orders.json.gz", "consumers": f"{d}/consumers.csv.gz",
                                    "merchants": f"{d}/merchants.csv.gz", "abtest": f"{d}/ab.tar.gz"},
                            partitions=4)
    report = pipeline.run_elt(raw, f"{d}/fact", run_date="2024-01-01")
    assert report["key_is_unique"] and report["n_rows"] == 1500
    assert report["counted_while_writing"] and report["run_date"] == "2024-01-01"
    saved = read_saved(spark, f"{d}/fact")
    assert saved_report(spark, f"{d}/fact") == report
    expected = _fact(spark, SF_SMALL)
    cols = [c for c in expected.columns if c != "items"]
    assert saved.select(cols).exceptAll(expected.select(cols)).count() == 0
    assert expected.select(cols).exceptAll(saved.select(cols)).count() == 0
    a, b = order_item_metrics(saved), order_item_metrics(expected)
    assert a.exceptAll(b).count() == 0


def test_analysis_exports_weekly_reports(spark, tmpdir_path):
    fact = materialize(_fact(spark, SF_SMALL), "fact_for_export")
    out = pipeline.run_analysis(fact, export_dir=f"{tmpdir_path}/reports")
    files = glob.glob(f"{tmpdir_path}/reports/weekly_city_metrics/*.csv")
    assert len(files) == 1
    with open(files[0]) as fh:
        header = fh.readline().strip().split(",")
        n = sum(1 for _ in fh)
    assert header[:3] == ["city_state", "abtest_group", "week"]
    assert n == out["weekly_city_metrics"].count()
    assert set(out) >= {"daily_city_lift", "monthly_segment_metrics", "welch_test", "significance"}


def test_parquet_and_export(spark, tmpdir_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    df.write.parquet(f"{tmpdir_path}/t.parquet")
    assert load_dataset(spark, f"{tmpdir_path}/t.parquet").count() == 2
    export_report(df, f"{tmpdir_path}/rep", ["k"])
    (f,) = glob.glob(f"{tmpdir_path}/rep/*.csv")
    assert open(f).read().splitlines() == ["k,v", "a,1", "b,2"]


def test_table_target_is_swapped_only_after_the_gate(spark):
    from splitlift.operators.quality import DataQualityError
    raw = pipeline.RawInputs(fx.fx_orders(spark, SF_SMALL), fx.fx_consumers(spark, SF_SMALL),
                             fx.fx_merchants(spark, SF_SMALL), fx.fx_abtest(spark, SF_SMALL))
    report = pipeline.run_elt(raw, "order_fact_t", run_date="2024-01-02", fmt="table")
    assert report["n_rows"] == 1500 and spark.read.table("order_fact_t").count() == 1500
    # duplicate merchants would multiply orders: refused before anything is joined
    bad = pipeline.RawInputs(raw.orders, raw.consumers, raw.merchants.unionByName(raw.merchants),
                             raw.abtest)
    with pytest.raises(DataQualityError):
        pipeline.run_elt(bad, "order_fact_t", run_date="2024-01-03", fmt="table")
    assert spark.read.table("order_fact_t").count() == 1500


def _inputs(spark):
    return pipeline.RawInputs(fx.fx_orders(spark, SF_SMALL), fx.fx_consumers(spark, SF_SMALL),
                              fx.fx_merchants(spark, SF_SMALL), fx.fx_abtest(spark, SF_SMALL))


@pytest.mark.parametrize("kind", ["csv", "archive"])
def test_columns_are_matched_by_header_name(spark, tmpdir_path, kind):
    body = b'extra,is_target,customer_id\n9,control,"1"\n8,target,2\n7,,3\n'
    path = os.path.join(tmpdir_path, "ab.csv" if kind == "csv" else "ab.tar.gz")
    if kind == "csv":
        with open(path, "wb") as f:
            f.write(body)
    else:
        _tar(path, [("ab.csv", body)])
    got = load_dataset(spark, path, schemas.ABTEST_RAW)
    assert got.columns == schemas.ABTEST_RAW.fieldNames()
    assert sorted((r.customer_id, r.is_target) for r in got.fillna("-").collect()) == [
        ("1", "control"), ("2", "target"), ("3", "-")]


@pytest.mark.parametrize("kind", ["csv", "archive"])
def test_a_missing_column_fails(spark, tmpdir_path, kind):
    path = os.path.join(tmpdir_path, "ab.csv" if kind == "csv" else "ab.tar.gz")
    if kind == "csv":
        with open(path, "wb") as f:
            f.write(b"customer,is_target\n1,control\n")
    else:
        _tar(path, [("ab.csv", b"customer,is_target\n1,control\n")])
    with pytest.raises(Exception, match="no column customer_id"):
        load_dataset(spark, path, schemas.ABTEST_RAW).collect()


def test_failing_gate_leaves_nothing_behind(spark, tmpdir_path):
    from splitlift.operators.quality import DataQualityError
    raw = _inputs(spark)
    raw.orders = raw.orders.limit(0)
    with pytest.raises(DataQualityError):
        pipeline.run_elt(raw, f"{tmpdir_path}/fact", run_date="2024-01-01")
    assert os.listdir(tmpdir_path) == []


def test_a_machine_local_folder_is_refused_on_a_cluster():
    from splitlift.session import build_session, checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
    with pytest.raises(ValueError):
        build_session("spark://host:7077")


def test_saved_tables_can_be_read_back(spark):
    from splitlift.sources.readers import read_saved
    spark.range(4).write.mode("overwrite").saveAsTable("saved_t")
    assert read_saved(spark, "saved_t", "table").count() == 4
