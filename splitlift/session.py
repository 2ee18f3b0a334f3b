"""Session helpers: the settings every transform in this package assumes."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings the library relies on. Timestamps are interpreted and shown in UTC;
# AQE re-plans joins/aggregates at runtime and splits skewed join partitions.
LIBRARY_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches of long texts by bytes, not only by rows: Python workers hold a few.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "splitlift", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass the cluster's own session instead."""
    if not master.startswith("local"):
        raise ValueError("build_session is for one machine; use the cluster's session")
    warehouse = tempfile.mkdtemp(prefix="splitlift-wh-", dir=os.environ.get("TMPDIR", "/tmp"))
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.warehouse.dir", warehouse)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g"))
    for key, value in {**LIBRARY_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_library_conf(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the transforms depend on (session zone above
    all) and make the package importable by the Python workers."""
    for key, value in LIBRARY_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (``addPyFile`` of a zip), once per
    application: the Arrow UDFs and ``mapInPandas`` functions live in it and
    are unpickled on the workers. Same as ``--py-files`` on spark-submit."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="splitlift-pyfiles-", dir=os.environ.get("TMPDIR", "/tmp"))
    archive = os.path.join(out_dir, "splitlift.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for plan cuts and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` (or a directory already
    registered on the context). Where both are unset, a local master (runs on
    one machine, tests) gets a fresh scratch folder; any other master is refused,
    since a folder of the driver's machine is not shared with the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a shared folder (master {sc.master})")
        current = tempfile.mkdtemp(prefix="splitlift-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current
