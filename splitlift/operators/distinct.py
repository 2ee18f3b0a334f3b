"""Exact distinct counts that merge.

Keys (customers) get dense numbers from 0. The set of keys of a group is then a few
bitmaps of 32,768 keys each: days merge into weeks and months, groups into all, by
``or``, and a merged bitmap's count is the distinct count. Nothing is expanded per
distinct aggregate, and stored day bitmaps need no second look at the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one partition: the low bits of monotonically_increasing_id.
_ROW_BITS = (1 << 33) - 1


def dense_numbers(keys: DataFrame, key: str, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(key, number): numbers 0, 1, 2, ... of the distinct non-NULL keys.

    Rows are numbered within their partition and written (``save``), so that neither
    part nor place can change if a task runs again. What the driver then adds up is one
    count per partition."""
    rows = save(keys.select(key).where(F.col(key).isNotNull()).distinct().select(
        key, F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("at")), "numbers")
    before, offsets = 0, []
    for r in rows.groupBy("part").count().orderBy("part").collect():
        offsets.append((r.part, before))
        before += r["count"]
    starts = keys.sparkSession.createDataFrame(offsets, "part int, before long")
    return rows.join(F.broadcast(starts), "part").select(key, (F.col("before") + F.col("at")).alias("number"))


def bitmaps(rows: DataFrame, by: Sequence[str], number: str = "number") -> DataFrame:
    """(by, bucket, bitmap) of the rows' numbers; rows without a number belong to none."""
    n = F.col(number) + 1  # Spark's buckets start at 1
    return (rows.where(F.col(number).isNotNull()).groupBy(*by, F.bitmap_bucket_number(n).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bitmap")))


def merge(maps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bitmaps by fewer or coarser columns."""
    return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def count(maps: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Distinct counts by ``by`` (all rows for none) of bitmaps that are merged so far."""
    return merge(maps, by).groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias(name))
