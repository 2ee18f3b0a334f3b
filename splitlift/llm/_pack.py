"""Texts as zstd blocks, for stages that have to shuffle them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ._text import slices


def pack_texts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``z``, the compressed text (NULL as empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for rows, raw, offsets in slices(batch, text_col):
                body, at = raw.tobytes(), offsets.tolist()
                packed = [zip_.compress(body[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in keep), pa.array(packed, pa.binary())], names=[*keep, "z"])
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, text_col).mapInArrow(run, f"{schema}, z binary")


def unpack_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with ``text`` in place of ``z``."""
    unzip = zstandard.ZstdDecompressor()
    texts = pa.array([unzip.decompress(z.as_py()).decode() for z in batch.column("z")], pa.large_string())
    others = [c for c in batch.schema.names if c != "z"]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), texts], names=[*others, "text"])
