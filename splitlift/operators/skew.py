"""Left joins whose hot and missing keys meet in no single task.

Keys with more rows than an average task are found beforehand (a summary with a fixed
number of counters, or a table of counts). Their few rows of the other side are
broadcast and joined where the left rows are; in the shuffled join that follows, those
left rows and the ones without a key carry a lane in place of the key, so they are dealt
evenly. A flag keeps lanes and keys apart: a lane matches nothing, whatever its value
is. The result does not depend on which keys were found.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES = 1024
HOT_KEYS = 64  # keys joined by broadcast: one row of the other side each
COUNTERS = 4096


def top_keys(key: str) -> Column:
    """Aggregate: candidates for hot keys with their estimated counts."""
    return F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {COUNTERS})")


def hot(found: Iterable[Row] | None, rows: int, tasks: int) -> list[str]:
    """Of keys with counts (``item``, ``count``), those with more rows than an average task."""
    return [r["item"] for r in found or () if r["item"] is not None and r["count"] * tasks > rows]


def hot_keys(df: DataFrame, keys: Sequence[str]) -> dict[str, list[str]]:
    """Hot values of each of the columns, from one pass over them."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *[top_keys(k).alias(k) for k in keys]).first()
    return {k: hot(row[k], row["n_rows"], tasks_of(df)) for k in keys}


def hot_of_counts(counts: DataFrame, key: str, n: str) -> list[str]:
    """Hot values from a table of exact counts, one row per value."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    most = (counts.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), F.col(n).alias("count"))
            .orderBy(F.desc("count")).limit(HOT_KEYS).collect())
    return hot(most, total, tasks_of(counts))


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: set[str], name: str) -> str:
    while name in taken:
        name += "_"
    taken.add(name)
    return name


def left_join(left: DataFrame, right: DataFrame, key: str, hot: Sequence[str] = (),
              spread: str | Sequence[str] = "order_id") -> DataFrame:
    """left LEFT JOIN right USING (key): the columns of ``left``, then the others of
    ``right``. ``right`` has a key once at most (rows without one are left out), and the
    other columns of the two differ. ``spread``: columns of ``left`` that tell rows
    apart; lanes are drawn from them."""
    payload = [c for c in right.columns if c != key]
    taken = set(left.columns) | set(right.columns)
    flag, lane, real, other, rest, few, near = (fresh(taken, n) for n in (
        "is_lane", "lane", "is_key", "other_key", "rest", "few_key", "near"))
    text = (F.col(key) + 0.0 if isinstance(left.schema[key].dataType, (T.DoubleType, T.FloatType))  # -0.0 is 0.0
            else F.col(key)).cast("string")
    apart = F.col(key).isNull()
    cold = F.col(key).isNotNull()
    values = F.struct(*[F.col(f"`{c}`") for c in payload])
    rows = left
    found = F.col(rest)
    if hot:
        apart = apart | F.col(key).isin(*hot)
        cold = cold & ~F.col(key).isin(*hot)
        # One row per hot key: HOT_KEYS rows at most.
        hot_rows = right.where(F.col(key).isin(*hot)).select(F.col(key).alias(few), values.alias(near))
        rows = rows.join(F.broadcast(hot_rows), F.col(key) == F.col(few), "left")
        found = F.coalesce(near, rest)
    drawn = F.pmod(F.xxhash64(*([spread] if isinstance(spread, str) else spread)), F.lit(LANES)).cast("string")
    rows = rows.withColumns({flag: F.when(apart, 1).otherwise(0), lane: F.when(apart, drawn).otherwise(text)})
    keyed = right.where(cold).select(F.lit(0).alias(real), text.alias(other), values.alias(rest))
    joined = rows.join(keyed, (F.col(flag) == F.col(real)) & (F.col(lane) == F.col(other)), "left")
    joined = joined.withColumn(rest, found)
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(rest)[c].alias(c) for c in payload])
