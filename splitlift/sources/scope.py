"""Scopes: who owns the tables that a run cuts its plans with, and when they go.

A scope is a folder ``splitlift_<application id>/<name>_<uuid>`` in the shared
checkpoint folder. Cuts made while it is open lie in it; closing it, on success or
failure, deletes them. Without an open scope, cuts belong to the application's own
scope, which is closed by :func:`close_application` or when the interpreter ends.

    with Scope(spark):
        reports = pipeline.run_analysis(fact)
        pipeline.write_reports(reports, path)

A driver that is killed closes nothing. Its folder carries its application id, so
:func:`sweep` can delete it later.
"""

from __future__ import annotations

import atexit
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir
from . import files

PREFIX = "splitlift_"

_open: dict[str, list["Scope"]] = {}
_application: dict[str, "Scope"] = {}


def root(spark: SparkSession) -> str:
    """The checkpoint folder that all applications of a cluster share."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (shared or checkpoint_dir(spark)).rstrip("/")


class Scope:
    """Owner of cut folders. Use as a context manager, or call :meth:`close`. Scopes
    nest; cuts go to the innermost open one of the application."""

    def __init__(self, spark: SparkSession, name: str = "run"):
        self.spark = spark
        self.app = spark.sparkContext.applicationId
        self.home = f"{root(spark)}/{PREFIX}{self.app}"
        self.folder = f"{self.home}/{name}_{uuid.uuid4().hex[:8]}"

    def cut(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet in this scope and read it back."""
        path = self.path(name)
        writer = df.write if compression is None else df.write.option("compression", compression)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        """A new folder's name in this scope, for a table written by the caller."""
        return f"{self.folder}/{name}_{uuid.uuid4().hex[:8]}"

    def close(self) -> None:
        files.delete(self.spark, self.folder)
        files.delete_if_empty(self.spark, self.home)

    def __enter__(self) -> "Scope":
        _open.setdefault(self.app, []).append(self)
        return self

    def __exit__(self, *error) -> None:
        _open[self.app].remove(self)
        self.close()


def current(spark: SparkSession) -> Scope:
    """The innermost open scope, else the application's own."""
    app = spark.sparkContext.applicationId
    if _open.get(app):
        return _open[app][-1]
    if app not in _application:
        _application[app] = Scope(spark, "application")
        atexit.register(_at_exit, app)
    return _application[app]


def close_application(spark: SparkSession) -> None:
    """Delete what was cut outside any scope. Call it when no DataFrame that reads
    those tables is needed any more."""
    own = _application.pop(spark.sparkContext.applicationId, None)
    if own:
        own.close()


def _at_exit(app: str) -> None:
    own = _application.pop(app, None)
    if own is None:
        return
    try:
        own.close()
    except Exception as gone:  # the JVM may have ended first; a sweep finds the folder
        print(f"splitlift: {own.folder} is left for a sweep ({type(gone).__name__})")


def sweep(spark: SparkSession, finished: Iterable[str] = (), idle_hours: float = 7 * 24) -> list[str]:
    """Delete the folders of other applications: those in ``finished``, and those in
    which no scope or cut was begun for ``idle_hours``. Returns their ids."""
    own, top = spark.sparkContext.applicationId, root(spark)
    oldest = (time.time() - idle_hours * 3600) * 1000
    gone, ended = [], set(finished)
    for name, changed in files.children(spark, top).items():
        app = name.removeprefix(PREFIX)
        if not name.startswith(PREFIX) or app == own:
            continue
        last = max([changed, *files.children(spark, f"{top}/{name}").values()])
        if app in ended or last < oldest:
            files.delete(spark, f"{top}/{name}")
            gone.append(app)
    return gone
