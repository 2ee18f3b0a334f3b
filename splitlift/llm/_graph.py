"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut
from ._rows import look_up


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node with a link; comp is its component's least node.

    Each turn re-hangs neighbours on the least one seen; the number of turns grows
    with the logarithm of a component's diameter. Minima are grouped aggregates
    with map-side partials, and the neighbours of a hub meet its minimum by lanes, so
    no task gets a whole star; only two numbers a turn reach the driver."""
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where("u > v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (look_up(both.where("v > u"), least, "u", "v")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = look_up(large, least, "u", "v").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    comps = edges.groupBy("u").agg(F.min("v").alias("comp"))
    return comps.select(F.col("u").alias("node"), "comp").unionByName(
        comps.select(F.col("comp").alias("node"), "comp").distinct())
