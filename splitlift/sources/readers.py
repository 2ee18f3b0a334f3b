"""Dataset readers: suffix dispatch over JSON lines, CSV, Parquet and CSV
inside tar.gz archives; plus catalog tables."""

from __future__ import annotations

import csv
import io
import itertools
import os
import tarfile
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import versioned

_JSON = (".json", ".json.gz", ".jsonl", ".jsonl.gz")
_CSV = (".csv", ".csv.gz")
_PARQUET = (".parquet",)
_ARCHIVE = (".tar.gz", ".tgz")


def detect_format(path: str) -> str:
    """'json' | 'csv' | 'parquet' | 'archive' from the (case-insensitive) suffix."""
    p = path.lower().rstrip("/")
    for fmt, suffixes in (("archive", _ARCHIVE), ("json", _JSON), ("csv", _CSV),
                          ("parquet", _PARQUET)):
        if p.endswith(suffixes):
            return fmt
    raise ValueError(f"unsupported dataset format: {path}")


def load_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 fmt: str | None = None, partitions: int | None = None) -> DataFrame:
    """Read one dataset by suffix (or ``fmt``).

    Give a schema wherever possible: it skips the inference pass over the
    whole input and keeps CSV columns typed as declared. Gzip files cannot be
    split, so each is read by one task; ``partitions`` spreads the rows out
    right after the scan for the stages that follow.
    """
    fmt = fmt or detect_format(path)
    if fmt == "json":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.json(path)
    elif fmt == "csv":
        # Text columns named by the header; a file whose header differs from the
        # first one's fails instead of being read by position.
        df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
        if schema is not None:
            df = _by_name(df, schema, path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
        if schema is not None:
            df = df.select(*schema.fieldNames())
    elif fmt == "archive":
        if schema is None:
            raise ValueError("archive datasets need a schema")
        df = read_archive_csv(spark, path, schema)
    else:
        raise ValueError(f"unsupported dataset format: {fmt}")
    if partitions:
        df = df.repartition(partitions)
    return df


def _by_name(df: DataFrame, schema: T.StructType, path: str) -> DataFrame:
    """The schema's columns, wherever the header has them; others are left out."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header ({', '.join(df.columns)})")
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_saved(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    """A saved dataset: a catalog table (``fmt='table'``) or files of a format. Of a
    target that is refreshed in versions, the committed one."""
    return versioned.target_of(spark, source, fmt).read()


def saved_report(spark: SparkSession, source: str, fmt: str = "parquet") -> dict | None:
    """What the gate found when a saved dataset was written; None if that is not known."""
    return versioned.target_of(spark, source, fmt).report()


class _Chunks(io.RawIOBase):
    """Pieces of bytes as one stream."""

    def __init__(self, chunks: Iterable[bytes]):
        self._chunks, self._left = iter(chunks), memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self._left:
            piece = next(self._chunks, None)
            if piece is None:
                return 0
            self._left = memoryview(piece)
        n = min(len(buffer), len(self._left))
        buffer[:n], self._left = self._left[:n], self._left[n:]
        return n


def _csv_members(tar: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """Regular members ending in .csv whose base name is not an AppleDouble ``._``
    companion."""
    for member in tar:
        base = os.path.basename(member.name)
        if member.isfile() and base.lower().endswith(".csv") and not base.startswith("._"):
            yield member


def _header(cells: list[str]) -> list[str]:
    raw = [c.encode("latin-1") for c in cells]
    try:
        return [c.decode("utf-8").strip("\ufeff ") for c in raw]
    except UnicodeDecodeError:
        return [c.strip(" ") for c in cells]


def _member_fields(path: str, stream: io.RawIOBase, names: list[str], every: bool) -> Iterator[tuple[str, list]]:
    """(member, fields as bytes) of an archive's CSV members, read as a stream. Fields
    are found in Latin-1, a character per byte, since CSV's own marks are ASCII."""
    found = False
    with tarfile.open(fileobj=io.BufferedReader(stream, 1 << 20), mode="r|*") as tar:
        for member in _csv_members(tar):
            found = True
            body = io.BufferedReader(_Chunks(iter(partial(tar.extractfile(member).read, 1 << 16), b"")))
            rows = csv.reader(io.TextIOWrapper(body, encoding="latin-1", newline=""))
            header = _header(next(rows, []))
            missing = [n for n in names if n not in header]
            if missing:
                raise ValueError(f"{path}: no column {', '.join(missing)} in the header")
            at = [header.index(n) for n in names]
            for r in rows:
                if r:
                    yield member.name, [r[i].encode("latin-1") if i < len(r) and r[i] != "" else None for i in at]
            if not every:
                break
    if not found:
        raise FileNotFoundError(f"no CSV member in {path}")


def _archive_rows(names: list[str], every: bool, batch_rows: int = 10_000):
    """``mapInArrow`` function from (path, bytes) pieces, in order, of archives to
    (path, member, fields). A piece and ``batch_rows`` rows are held at a time."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            parts = batch.column("part")
            for path, run in itertools.groupby(range(batch.num_rows), lambda i: paths[i]):
                yield path, b"".join(parts[i].as_py() for i in run)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, run in itertools.groupby(pieces(batches), lambda piece: piece[0]):
            rows = _member_fields(path, _Chunks(p[1] for p in run), names, every)
            while chunk := list(itertools.islice(rows, batch_rows)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(chunk)), pa.array([m for m, _ in chunk]),
                     pa.array([f for _, f in chunk], pa.list_(pa.binary()))], names=["path", "member", "fields"])
    return run


def read_archive_csv(spark: SparkSession, path: str, schema: T.StructType, every: bool = False) -> DataFrame:
    """CSV (with header) stored inside tar.gz archives -> typed DataFrame.

    Spark's text reader unpacks ``.gz`` as a stream and hands over what lies between two
    line ends, from which a task puts the tar stream together again: any size of archive
    passes through a task in pieces, from any file system that Spark reads. Each archive
    is one task (gzip is not splittable); many are read in parallel. ``.tgz``, whose
    ending the reader does not know, goes whole through ``binaryFile`` (2 GB at most).

    The first CSV member counts, or every one. Columns are matched by header name. A
    member is UTF-8 or, if any of its fields is not, Latin-1 throughout."""
    names = schema.fieldNames()
    if path.lower().rstrip("/").endswith(".tgz"):
        pieces = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("part"))
    else:
        line = F.concat(F.col("value").cast("binary"), F.lit(b"\n"))
        pieces = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("path"), line.alias("part"))
    rows = pieces.mapInArrow(_archive_rows(names, every), "path string, member string, fields array<binary>")
    broken = F.exists("fields", lambda f: f.isNotNull() & ~F.is_valid_utf8(f.cast("string")))
    latin = (rows.where(broken).select(F.col("path").alias("of"), F.col("member").alias("in")).distinct()
             .withColumn("latin", F.lit(True)))
    same = (F.col("path") == F.col("of")) & (F.col("member") == F.col("in"))
    fields = rows.join(latin, same, "left")

    def text(i: int) -> Column:
        raw = F.col("fields")[i]
        return F.when(F.col("latin"), F.decode(raw, "ISO-8859-1")).otherwise(raw.cast("string"))
    return fields.select(*[text(i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])
