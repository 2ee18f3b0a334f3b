"""Exact deduplication with a heavy-hitter split (native DataFrame operations).

1. Every row gets the SHA-256 of its text; the narrow digest table is cut once,
   so the text is read a single time.
2. ``approx_top_k`` (a Misra-Gries summary, merged from per-task partials)
   proposes frequent digests. The summary tracks ``MG_ITEMS`` counters, hence
   any digest with more than about 4 / MG_ITEMS of all rows is among them.
3. The proposals are verified: exact size and keeper of each, from one
   aggregate with map-side partials. The winners number ``MG_TOP`` at most, so
   broadcasting them is bounded whatever the input is; their copies are decided
   map-side and never shuffled.
4. The remaining digests, each a small share of the rows, are shuffled as usual.

Defined cases: a NULL text counts as empty; a NULL id ranks below every other;
of repeated rows (same id and text) exactly one is kept; an empty table gives
an empty result; further columns of the input are ignored by ``exact_dedup`` and
passed on by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import cut
from ._rows import free_names

MG_ITEMS = 16384
MG_TOP = 1000


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def frequent_digests(digests: DataFrame, items: int = MG_ITEMS, top: int = MG_TOP) -> DataFrame:
    """At most ``top`` digests proposed by the Misra-Gries summary."""
    found = digests.agg(F.expr(f"approx_top_k(digest, {top}, {items})").alias("top"))
    return found.select(F.explode("top.item").alias("digest"))


def verified_winners(digests: DataFrame, items: int = MG_ITEMS, top: int = MG_TOP) -> DataFrame:
    """(digest, keep, group_size) of the proposals that really have copies."""
    proposed = F.broadcast(frequent_digests(digests, items, top))
    return (digests.join(proposed, "digest", "left_semi")
            .groupBy("digest")
            .agg(F.max(F.struct("id", "uid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                items: int = MG_ITEMS, top: int = MG_TOP) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    digests = cut(df.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"),
                            F.monotonically_increasing_id().alias("uid")), "digests")
    winners = cut(verified_winners(digests, items, top), "winners")  # <= top rows

    heavy = digests.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    light = (digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
             .withColumn("keep", F.max(F.struct("id", "uid")).over(same))
             .withColumn("group_size", F.count(F.lit(1)).over(same)))
    both = heavy.select("id", "uid", "digest", "keep", "group_size").unionByName(
        light.select("id", "uid", "digest", "keep", "group_size"))
    return both.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("group_size"),
        (F.col("uid") == F.col("keep.uid")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                items: int = MG_ITEMS, top: int = MG_TOP) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns. Copies of the winners go
    map-side, before the texts that remain are shuffled once."""
    digest, heavy, kept, nth = free_names(df, "digest", "heavy", "kept", "nth")
    rows = df.withColumn(digest, text_digest(F.col(text_col)))
    digests = cut(rows.select(F.col(id_col).alias("id"), F.col(digest).alias("digest"),
                              F.monotonically_increasing_id().alias("uid")), "digests")
    winners = cut(verified_winners(digests, items, top), "winners")
    keep = winners.select(F.col("digest").alias(heavy), F.col("keep.id").alias(kept))
    left = (rows.join(F.broadcast(keep), F.col(digest) == F.col(heavy), "left")
            .where(F.col(heavy).isNull() | F.col(id_col).eqNullSafe(F.col(kept))))
    order = Window.partitionBy(digest).orderBy(F.col(id_col).desc_nulls_last())
    first = left.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return first.select(*[F.col(f"`{c}`") for c in df.columns])
