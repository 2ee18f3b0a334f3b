"""Full refresh of a target that survives a driver's death at any point.

Every refresh writes a new version beside the old one; nothing that readers use is
moved or overwritten. One atomic step then makes the new version the current one:

- files: ``<target>/_v00000007`` holds the data, ``<target>/_journal`` the entries
  ``00000007.intent`` (written before the data) and ``00000007.committed`` (renamed
  into place when the data has passed its checks, with their report in it). The
  current version is the largest committed one.
- tables: ``<target>__v00000007`` holds the data and ``<target>`` is a view on the
  committed version; replacing the view is the commit, its properties hold the report.

The next run first rolls back whatever was begun and not committed. The version before
the current one is kept for readers that resolved it earlier. A target has one writer
at a time; a second writer rolls back the first one's version, whose commit then fails.

A target that was written plainly before (files in the folder itself, or a table of
that name) stays readable until the first commit and is replaced by it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files

JOURNAL = "_journal"
INTENT, COMMITTED, DRAFT = "intent", "committed", "draft"
KEPT = 2
DIGITS = 8


def _step(name: str) -> None:
    """A point between two steps of a refresh; tests end a run here."""


class FileTarget:
    """A folder of versions with a journal."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt
        self.journal = f"{self.path}/{JOURNAL}"

    def location(self, version: int) -> str:
        return f"{self.path}/_v{version:0{DIGITS}d}"

    def _entry(self, version: int, state: str) -> str:
        return f"{self.journal}/{version:0{DIGITS}d}.{state}"

    def _entries(self) -> dict[int, set[str]]:
        out: dict[int, set[str]] = {}
        for name in files.children(self.spark, self.journal):
            number, _, state = name.partition(".")
            if number.isdigit():
                out.setdefault(int(number), set()).add(state)
        return out

    def current(self) -> int | None:
        return max((v for v, states in self._entries().items() if COMMITTED in states), default=None)

    def report(self) -> dict | None:
        """What the checks of the current version found; None for a plain target."""
        version = self.current()
        return None if version is None else json.loads(files.read(self.spark, self._entry(version, COMMITTED)))

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        return self.spark.read.format(self.fmt).load(self.path if version is None else self.location(version))

    def recover(self) -> None:
        """Roll back versions that were begun and not committed."""
        for version, states in self._entries().items():
            if COMMITTED not in states:
                files.delete(self.spark, self.location(version))
                _step("rolled back data")
            for state in states - {COMMITTED}:
                files.delete(self.spark, self._entry(version, state))
        if not self._entries():
            files.delete_if_empty(self.spark, self.journal)
            files.delete_if_empty(self.spark, self.path)

    def begin(self) -> int:
        version = max(self._entries(), default=0) + 1
        files.write_new(self.spark, self._entry(version, INTENT), "{}")
        return version

    def write(self, df: DataFrame, version: int) -> None:
        df.write.format(self.fmt).save(self.location(version))

    def commit(self, version: int, report: dict) -> None:
        if INTENT not in self._entries().get(version, ()):
            raise RuntimeError(f"{self.path}: version {version} was rolled back by another writer")
        files.write_new(self.spark, self._entry(version, DRAFT), json.dumps(report))
        _step("drafted")
        files.rename(self.spark, self._entry(version, DRAFT), self._entry(version, COMMITTED))

    def clean(self) -> None:
        """Drop versions that no reader should hold any more, and plain files."""
        committed = sorted(v for v, states in self._entries().items() if COMMITTED in states)
        for version in committed[:-KEPT]:
            files.delete(self.spark, self.location(version))
            _step("dropped data")
            files.delete(self.spark, self._entry(version, COMMITTED))
        if committed:
            files.delete(self.spark, self._entry(committed[-1], INTENT))
            for name in files.children(self.spark, self.path):
                if name != JOURNAL and not name.startswith("_v"):
                    files.delete(self.spark, f"{self.path}/{name}")


class TableTarget:
    """A view on one of several version tables of the catalog."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def location(self, version: int) -> str:
        return f"{self.name}__v{version:0{DIGITS}d}"

    def _versions(self) -> list[int]:
        database, _, short = self.name.rpartition(".")
        within = f"IN {database} " if database else ""
        names = [r.tableName for r in self.spark.sql(f"SHOW TABLES {within}LIKE '{short}__v*'").collect()]
        numbers = [n[len(short) + 3:] for n in names if n.lower().startswith(f"{short}__v".lower())]
        return sorted(int(n) for n in numbers if n.isdigit())

    def _properties(self) -> dict[str, str]:
        """Those of the view; empty if there is none, or a plain table."""
        if not self.spark.catalog.tableExists(self.name):
            return {}
        return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()}

    def current(self) -> int | None:
        at = self._properties().get("splitlift.version")
        if at is not None:
            return int(at)
        # A plain table that was set aside as version 0 by a run that ended there.
        return 0 if not self.spark.catalog.tableExists(self.name) and 0 in self._versions() else None

    def report(self) -> dict | None:
        text = self._properties().get("splitlift.report")
        return json.loads(text) if text else None

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        return self.spark.read.table(self.name if version is None else self.location(version))

    def recover(self) -> None:
        """Drop versions that were begun and not committed; a plain table that was set
        aside gets its view."""
        current = self.current()
        if current == 0 and not self.spark.catalog.tableExists(self.name):
            self._point(0, {})
        for version in self._versions():
            if current is None or version > current:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.location(version)}")

    def begin(self) -> int:
        return max([self.current() or 0, *self._versions()]) + 1

    def write(self, df: DataFrame, version: int) -> None:
        df.write.saveAsTable(self.location(version))

    def _point(self, version: int, report: dict) -> None:
        text = json.dumps(report).replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} "
                       f"TBLPROPERTIES ('splitlift.version' = '{version}', 'splitlift.report' = '{text}') "
                       f"AS SELECT * FROM {self.location(version)}")

    def commit(self, version: int, report: dict) -> None:
        if version not in self._versions():
            raise RuntimeError(f"{self.name}: version {version} was rolled back by another writer")
        if self.spark.catalog.tableExists(self.name) and self.current() is None:
            self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {self.location(0)}")
            _step("set aside")
        self._point(version, report)

    def clean(self) -> None:
        current = self.current()
        for version in self._versions():
            if current is not None and version < current and version not in self._versions()[-KEPT:]:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.location(version)}")
                _step("dropped data")


def target_of(spark: SparkSession, target: str, fmt: str = "parquet") -> FileTarget | TableTarget:
    return TableTarget(spark, target) if fmt == "table" else FileTarget(spark, target, fmt)


def refresh(df: DataFrame, target: str, check: Callable[[DataFrame], dict], fmt: str = "parquet") -> dict:
    """Replace the whole target by ``df``. ``check`` gets what was written and returns
    its report, or raises, in which case the old version stays the current one."""
    to = target_of(df.sparkSession, target, fmt)
    to.recover()
    _step("recovered")
    version = to.begin()
    _step("begun")
    try:
        to.write(df, version)
        _step("written")
        report = check(to.read(version))
        _step("checked")
        to.commit(version, report)
    except Exception:
        to.recover()
        raise
    _step("committed")
    to.clean()
    return report
