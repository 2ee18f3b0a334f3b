"""Raw-shaped inputs derived, with Spark, from the star-schema tables.

The pipeline expects four raw datasets (orders with JSON items, consumers,
restaurants, A/B assignment). These views build them from ``orders``,
``lineitem``, ``customer``, ``supplier``, ``nation`` and ``region`` so every
operator runs over the whole given tables; ``plans/oracle.py`` derives the
same values in SQL. The derivation rules are documented in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation (FIXTURES.md §3).
# Regions, offsets, an unknown name and no zone at all, by order key mod 8.
ZONES = ("America/Sao_Paulo", "America/Manaus", "UTC", "-03:00", "GMT+5", "Europe/Berlin", "Mars/Base", None)
N_VALID_ZONES = 6
MALFORMED = "not json"
LANGUAGES = ("pt", "en", "es")
CURRENCY = "BRL"
FIXED_CREATED_AT = "2018-01-01"


_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table. The tables are read-only inputs, so the DataFrame (its
    file listing and footer schema, not data) is built once per session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def _txt(c: Column) -> Column:
    return c.cast("string")


def _cents(amount: str) -> Column:
    """Cents of a 2-decimal amount (exact: the double is within 1e-9 of it)."""
    return F.round(F.col(amount) * 100).cast("long")


def _share_cents(cents: Column, rate: str) -> Column:
    """Cents of ``amount * rate`` for a 2-decimal rate, rounded half-up, in
    exact integer arithmetic (equal to the DECIMAL product rounded)."""
    return F.floor((cents * _cents(rate) + F.lit(50)) / F.lit(100)).cast("long")


def _money(cents: Column) -> Column:
    return F.struct(_txt(cents).alias("value"), F.lit(CURRENCY).alias("currency"))


def _pick(key: Column, values: tuple[str | None, ...]) -> Column:
    expr = None
    for i, v in enumerate(values[:-1]):
        expr = F.when(key == i, v) if expr is None else expr.when(key == i, v)
    return expr.otherwise(F.lit(values[-1]))


def fx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line, with its amounts in cents and how often its item is in the
    basket: the first line of some orders is there twice (identical items). Numbers
    only: the items are made of them where the basket is complete."""
    value = _cents("l_extendedprice")
    twice = (F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 6 == 0)
    return table(spark, sf_dir, "lineitem").select(
        _txt(F.col("l_orderkey")).alias("of_order"), "l_suppkey", "l_partkey", "l_linenumber", "l_quantity",
        (F.col("l_tax") > 0).alias("taxed"),
        value.alias("value_c"),
        _share_cents(value, "l_discount").alias("discount_c"),
        _share_cents(value, "l_tax").alias("tax_c"),
        F.when(twice, 2).otherwise(1).alias("copies"))


def _item(line: Column) -> Column:
    """The order item of a line; taxed lines have a sub-item, large ones of them two."""
    def sub_item(name: str, sequence: int, value: Column, discount: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), _money(discount).alias("discount"), F.lit(1.0).alias("quantity"),
                        F.lit(sequence).alias("sequence"), _money(value).alias("totalValue"))
    first = sub_item("extra", 1, line["tax_c"], F.floor(line["tax_c"] / 10).cast("long"))
    second = sub_item("second", 2, F.lit(50).cast("long"), F.lit(5).cast("long"))
    taxed, large = line["taxed"], line["l_quantity"] > 25
    garnish = (F.when(taxed & large, F.array(first, second)).when(taxed, F.array(first))
               .otherwise(F.array_repeat(first, 0)))
    return F.struct(
        line["l_linenumber"].alias("sequence"),
        line["l_quantity"].alias("quantity"),
        _txt(line["l_partkey"]).alias("externalId"),
        _money(line["value_c"]).alias("totalValue"),
        _money(line["discount_c"]).alias("totalDiscount"),
        garnish.alias("garnishItems"))


def fx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw orders, items as a JSON array text: one row per order, and for some orders
    an older version or an exact copy as well.

    The lines of an order are gathered with ``collect_list`` per order id; that group is
    one order's basket (a handful of lines), the same unit the raw file stores in one
    JSON field. What is exchanged and sorted are narrow rows: orders meet their customers
    first, then the baskets' numbers, and the text, many times as long, is written last.
    Rows come out by order id, so grouping them by it needs no further exchange."""
    # Partitioned by order id before the baskets are gathered: no partial baskets.
    lines = fx_lines(spark, sf_dir).repartition("of_order")
    baskets = lines.groupBy("of_order").agg(
        F.min("l_suppkey").alias("first_supplier"),
        F.collect_list(F.struct("l_partkey", "l_linenumber", "l_quantity", "taxed", "value_c", "discount_c", "tax_c",
                                "copies")).alias("lines"))
    cust = (table(spark, sf_dir, "customer")
            .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("c_custkey", "c_name", "n_name", "r_name"))
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    older = (key % 13 == 0) & (key % len(ZONES) < N_VALID_ZONES)
    versions = F.concat(F.array(F.lit(0)), F.when(older, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
                        F.when(key % 17 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")))
    rows = (o.join(cust, o.o_custkey == cust.c_custkey, "left")
             .withColumn("version", F.explode(versions)).withColumn("order_id", _txt(key)))
    joined = rows.join(baskets, rows.order_id == baskets.of_order, "left")
    items = F.to_json(F.flatten(F.transform("lines", lambda line: F.array_repeat(_item(line), line["copies"]))))
    is_older = F.col("version") == 1
    created = F.col("o_orderdate") - F.when(is_older, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))
    name = F.when(key % 5 == 0, F.concat(F.lit("José  "), "c_name", F.lit(" &amp; Cia"))).otherwise(F.col("c_name"))
    city = F.when(key % 9 == 0, F.concat(F.lit("São "), "n_name")).otherwise(F.col("n_name"))
    return joined.select(
        F.when(key % 19 != 0, _txt(F.col("o_custkey"))).alias("customer_id"),
        F.when(key % 7 != 0, name).alias("customer_name"),
        F.when(key % 11 != 0, city).alias("delivery_address_city"),
        _txt(F.col("o_custkey")).alias("delivery_address_external_id"),
        F.col("r_name").alias("delivery_address_state"),
        _txt(F.col("first_supplier")).alias("merchant_id"),
        F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss").alias("order_created_at"),
        _pick(key % len(ZONES), ZONES).alias("merchant_timezone"),
        "order_id",
        (F.col("o_totalprice") + F.when(is_older, 1.0).otherwise(0.0)).alias("order_total_amount"),
        F.when(is_older, "older").otherwise(F.col("o_orderpriority")).alias("origin_platform"),
        F.lit(None).cast("string").alias("order_scheduled_date"),
        F.when(key % 23 == 0, MALFORMED).otherwise(items).alias("items"),
    )


def fx_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        _txt(F.col("c_custkey")).alias("customer_id"),
        _pick(F.col("c_custkey") % 3, LANGUAGES).alias("language"),
        F.lit(FIXED_CREATED_AT).alias("created_at"),
        F.when(F.col("c_acctbal") >= 0, "true").otherwise("false").alias("active"),
        F.when(F.col("c_custkey") % 4 == 1, F.concat("c_name", F.lit(" Ção")))
         .otherwise(F.col("c_name")).alias("customer_name"),
        _txt(F.col("c_nationkey")).alias("customer_phone_area"),
        _txt(F.col("c_custkey")).alias("customer_phone_number"),
    )


def fx_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (table(spark, sf_dir, "supplier")
         .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
         .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    k = F.col("s_suppkey")
    tenths = F.floor(F.abs(F.col("s_acctbal")) / 10).cast("long")
    ticket = F.concat(_txt(F.floor(tenths / 10).cast("long")), F.lit("."), _txt(tenths % 10))
    return s.select(
        _txt(k).alias("id"),
        F.lit(FIXED_CREATED_AT).alias("created_at"),
        F.when(F.col("s_acctbal") >= 0, "true").otherwise("false").alias("enabled"),
        _txt(k % 5 + 1).alias("price_range"),
        F.when(k % 10 != 9, ticket).alias("average_ticket"),
        _txt(k % 30).alias("takeout_time"),
        _txt(k % 60).alias("delivery_time"),
        _txt(F.col("s_acctbal")).alias("minimum_order_value"),
        _txt(k + 10000).alias("merchant_zip_code"),
        F.when(k % 4 == 0, F.concat("n_name", F.lit(" d'Été"))).otherwise(F.col("n_name")).alias("merchant_city"),
        F.col("r_name").alias("merchant_state"),
        F.lit("XX").alias("merchant_country"),
    )


def fx_abtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.filter(F.col("c_custkey") % 10 != 9).select(
        _txt(F.col("c_custkey")).alias("customer_id"),
        F.when(F.col("c_custkey") % 2 == 0, "control").otherwise("target").alias("is_target"))
