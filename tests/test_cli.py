import glob
import io
import os
import tarfile

from splitlift.__main__ import main
from splitlift.sources import fixtures as fx

from conftest import SF_SMALL


def test_elt_then_analysis(spark, tmpdir_path):
    d = tmpdir_path
    fx.fx_orders(spark, SF_SMALL).write.json(f"{d}/orders.json")
    fx.fx_consumers(spark, SF_SMALL).write.option("header", True).csv(f"{d}/consumers.csv")
    fx.fx_merchants(spark, SF_SMALL).write.option("header", True).csv(f"{d}/merchants.csv")
    data = fx.fx_abtest(spark, SF_SMALL).toPandas().to_csv(index=False).encode()   # small fixture
    with tarfile.open(f"{d}/ab.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("ab.csv")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert main(["elt", "--orders", f"{d}/orders.json", "--consumers", f"{d}/consumers.csv",
                 "--merchants", f"{d}/merchants.csv", "--abtest", f"{d}/ab.tar.gz",
                 "--target", f"{d}/fact", "--run-date", "2024-01-01"]) == 0
    assert main(["analysis", "--fact", f"{d}/fact", "--out", f"{d}/out"]) == 0
    written = {os.path.basename(p) for p in glob.glob(f"{d}/out/parquet/*")}
    assert {"weekly_city_lift", "significance", "top_cities"} <= written
    assert glob.glob(f"{d}/out/csv/weekly_city_metrics/*.csv")
