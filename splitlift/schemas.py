"""Schemas of the raw inputs and of the nested order items.

Field names below are a data format shared with the producers of the raw
files, so they are fixed values and must stay exactly as written.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _money() -> T.StructType:
    return T.StructType([T.StructField("value", _S), T.StructField("currency", _S)])


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# Sub-item ("garnish") fields, in their natural order.
GARNISH_ITEM = _struct([
    ("name", _S), ("addition", _money()), ("discount", _money()),
    ("quantity", T.DoubleType()), ("sequence", T.IntegerType()),
    ("unitPrice", _money()), ("categoryId", _S), ("externalId", _S),
    ("totalValue", _money()), ("categoryName", _S), ("integrationId", _S),
])

# Item fields, in their natural order. Items carry
# ``totalDiscount``; sub-items only ``discount``.
ORDER_ITEM = _struct([
    ("name", _S), ("addition", _money()), ("discount", _money()),
    ("quantity", T.DoubleType()), ("sequence", T.IntegerType()),
    ("unitPrice", _money()), ("externalId", _S), ("totalValue", _money()),
    ("customerNote", _S), ("garnishItems", T.ArrayType(GARNISH_ITEM)),
    ("integrationId", _S), ("totalAddition", _money()), ("totalDiscount", _money()),
])

ITEMS = T.ArrayType(ORDER_ITEM)

_MAP = T.MapType(_S, _S)

# Alternative, loosely typed item layout (money as string maps).
ITEMS_LENIENT = T.ArrayType(_struct([
    ("name", _S), ("quantity", T.DoubleType()), ("unitPrice", _MAP),
    ("totalValue", _MAP), ("externalId", _S), ("garnishItems", T.ArrayType(_MAP)),
    ("customerNote", _S), ("integrationId", _S), ("addition", _MAP),
    ("discount", _MAP), ("totalAddition", _MAP), ("totalDiscount", _MAP),
    ("sequence", T.DoubleType()),
]))


def _strings(names: list[str]) -> T.StructType:
    return _struct([(n, _S) for n in names])


# Raw orders (JSON lines). ``items`` arrives as JSON text.
ORDERS_RAW = _struct([
    ("customer_id", _S), ("customer_name", _S), ("delivery_address_city", _S),
    ("delivery_address_external_id", _S), ("delivery_address_state", _S),
    ("merchant_id", _S), ("order_created_at", _S), ("merchant_timezone", _S),
    ("order_id", _S), ("order_total_amount", T.DoubleType()),
    ("origin_platform", _S), ("order_scheduled_date", _S), ("items", _S),
])

# Raw consumers (CSV with header, every column text).
CONSUMERS_RAW = _strings([
    "customer_id", "language", "created_at", "active", "customer_name",
    "customer_phone_area", "customer_phone_number",
])

# Raw restaurants (CSV with header, every column text).
MERCHANTS_RAW = _strings([
    "id", "created_at", "enabled", "price_range", "average_ticket", "takeout_time",
    "delivery_time", "minimum_order_value", "merchant_zip_code", "merchant_city",
    "merchant_state", "merchant_country",
])

# Raw A/B assignment (CSV inside a tar.gz).
ABTEST_RAW = _strings(["customer_id", "is_target"])

# Order fact columns, in output order.
ORDER_FACT_COLUMNS = [
    "order_id", "order_created_at_utc", "order_scheduled_date", "origin_platform",
    "merchant_timezone", "customer_name", "delivery_address_city",
    "delivery_address_state", "delivery_address_external_id", "order_total_amount",
    "items", "merchant_id", "customer_id", "language", "consumer_created_at", "active",
    "customer_phone_area", "customer_phone_number", "merchant_created_at", "enabled",
    "price_range", "average_ticket", "takeout_time", "delivery_time",
    "minimum_order_value", "merchant_city", "merchant_state", "merchant_country",
    "abtest_group",
]
