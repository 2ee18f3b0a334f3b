"""Cleaning of the raw orders, consumers and merchants (plus deduplication)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import local_to_utc, parse_items, round_half_up, step_bucket
from ..functions.text import clean_text, zero_pad


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return False
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    return True


def dedup_latest(df: DataFrame, keys: Sequence[str], latest: str | Column,
                 latest_name: str = "__latest") -> DataFrame:
    """Keep one row per key: the one with the greatest ``latest`` value (NULL
    counts as oldest); ties are broken by the remaining orderable columns, in
    column order, greatest first. Fully identical rows collapse to one.

    Planned as a grouped ``max`` of one struct (latest value first, then the
    payload), unpacked again: each column travels once, and the aggregate
    combines map-side, so a key with millions of copies is reduced inside every
    input task instead of being sorted in a single one. Only columns that cannot
    be compared (maps) are carried next to the struct that ranks them.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    types = {f.name: f.dataType for f in df.schema.fields}
    named = isinstance(latest, str)
    first = F.col(latest) if named else latest.alias(latest_name)
    rank = F.struct(first, *[F.col(c) for c in payload
                             if _orderable(types[c]) and not (named and c == latest)])
    others = [c for c in payload if not _orderable(types[c])]
    if others:
        best = F.max_by(F.struct(rank.alias("rank"), *[F.col(c) for c in others]), rank)
        at = {c: f"__best.{c}" if c in others else f"__best.rank.{c}" for c in payload}
    else:
        best = F.max(rank)
        at = {c: f"__best.{c}" for c in payload}
    rows = df.groupBy(*keys).agg(best.alias("__best"))
    return rows.select(*[F.col(k) for k in keys], *[F.col(at[c]).alias(c) for c in payload]).select(*df.columns)


def clean_orders(raw: DataFrame, name_width: int = 7) -> DataFrame:
    """Latest row per ``order_id`` (by UTC creation time), then the cleaned
    13-column projection. Items are parsed only for the surviving rows. Raw orders
    without ``items`` give the same rows without that column: it is the last that
    breaks ties, so it decides nothing about the others."""
    with_utc = raw.withColumn(
        "order_created_at_utc", local_to_utc("order_created_at", "merchant_timezone"))
    latest = dedup_latest(with_utc, ["order_id"], "order_created_at_utc")
    return latest.select(
        "customer_id",
        clean_text("customer_name").alias("customer_name"),
        clean_text("delivery_address_city").alias("delivery_address_city"),
        zero_pad("delivery_address_external_id", name_width).alias("delivery_address_external_id"),
        "delivery_address_state",
        "merchant_id",
        "order_created_at_utc",
        "order_id",
        round_half_up("order_total_amount", 2).alias("order_total_amount"),
        "origin_platform",
        "order_scheduled_date",
        *([parse_items("items").alias("items")] if "items" in raw.columns else []),
        "merchant_timezone",
    )


def narrow_orders(raw: DataFrame) -> DataFrame:
    """The rows of :func:`clean_orders`, with items only where the order has no id: the
    others can be met by it (``fact.order_fact``)."""
    return clean_orders(raw.withColumn("items", F.when(F.col("order_id").isNull(), F.col("items"))))


def clean_consumers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id", "language", "created_at", "active",
        clean_text("customer_name").alias("customer_name"),
        "customer_phone_area", "customer_phone_number",
    )


def clean_merchants(raw: DataFrame, ticket_bounds: Sequence[float] = (30, 40, 60, 80),
                    ticket_last: int = 100) -> DataFrame:
    return raw.select(
        F.col("id").alias("merchant_id"),
        "created_at", "enabled", "price_range",
        step_bucket("average_ticket", ticket_bounds, ticket_last).alias("average_ticket"),
        "takeout_time", "delivery_time",
        round_half_up("minimum_order_value", 2).alias("minimum_order_value"),
        "merchant_zip_code",
        clean_text("merchant_city").alias("merchant_city"),
        "merchant_state", "merchant_country",
    )
