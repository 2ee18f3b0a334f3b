"""Drawing rows of a table by their id, dropping rows by a key of id and text, and
joins on keys that any share of the rows may hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import cut

LANES = 256


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def hash_limit(sample: int, rows: int) -> int:
    """Rows with ``xxhash64(id)`` up to this number are about ``sample`` of ``rows``, at
    any number of rows; all where there are no more."""
    return 2 ** 63 - 1 if rows <= sample else sample * 2 ** 64 // rows - 2 ** 63


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def look_up(big: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` on ``key``, where one key may hold any share of ``big``.

    Each row of ``big`` has one of LANES lanes, drawn from the column ``spread``. The
    lanes in use of every key fetch its rows of ``small`` first (at most LANES lanes a
    key, found with map-side partials), then rows meet them by key and lane: no task
    gets more than a lane of a key, whatever the settings of skew joins are."""
    (lane,) = free_names(big.join(small, key), "lane")
    dealt = big.withColumn(lane, F.pmod(F.xxhash64(spread), F.lit(LANES)))
    fetched = dealt.select(key, lane).distinct().join(small, key)
    return dealt.join(fetched, [key, lane], how).drop(lane)


def drop_rows(df: DataFrame, drop: DataFrame, id_col: str, text_col: str, again: DataFrame | None = None
              ) -> DataFrame:
    """``df`` without the rows whose key is in ``drop`` (a column dk). Of rows that
    share a key in ``again``, one stays.

    Both key lists are cut first, so the planner knows their size: short ones are
    broadcast and no text is shuffled, long ones are joined by sorting."""
    own, dk = free_names(df, "own_key", "drop_key")
    rows = df.withColumn(own, row_key(id_col, text_col))
    gone = cut(drop.select(F.col("dk").alias(dk)).distinct(), "drop")
    match = F.col(own) == F.col(dk)
    columns = [F.col(f"`{c}`") for c in df.columns]
    if again is None:
        return rows.join(gone, match, "left_anti").select(*columns)
    twice = cut(again.select(F.col("dk").alias(dk)).distinct().join(gone, dk, "left_anti"), "again")
    once = rows.join(gone.union(twice), match, "left_anti")
    first = rows.join(twice, match, "left_semi").dropDuplicates([own])
    return once.unionByName(first).select(*columns)
