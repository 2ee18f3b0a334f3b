"""Independent SQL (DuckDB dialect) for every query of the catalog.

Each statement derives its inputs from the base tables itself (no Spark code
involved), following FIXTURES.md. Conventions that keep results bit-equal:

* money is summed as integer cents, then divided in double, like the library;
* ``R(x, d)`` rounds a double half-up on its shortest decimal text, which is
  how Spark's ``round`` on doubles behaves (DuckDB's own ``round`` works on the
  binary value and differs on ties such as 1.005);
* divisions that may hit zero use ``NULLIF`` (Spark side: ``try_divide``).
"""

from __future__ import annotations

from ..schemas import ITEMS


def R(expr: str, digits: int = 2) -> str:
    return (f"CAST(ROUND(CAST(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), "
            f"{digits}) AS DOUBLE)")


def FOLD_ASCII(x: str) -> str:
    """Lenient normaliser for printable-ASCII text without '&'."""
    return f"CASE WHEN ({x}) = '' THEN NULL ELSE regexp_replace(trim(upper({x})), ' {{2,}}', ' ', 'g') END"


def UNESCAPE(x: str) -> str:
    # The entities that occur in the given tables. All of them are legacy
    # names, which HTML decoding also accepts without the ';'. 'amp' goes last
    # and in one regex pass, so '&amp;copy;' becomes '&copy;' (one decoding).
    out = x
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"),
                       ("amp", "&")):
        out = f"regexp_replace({out}, '&{name};?', '{char}', 'g')"
    return out


_WS = r"[\s\x0b\x1c-\x1f]+"


def FOLD(x: str) -> str:
    """Lenient normaliser, general text (accents folded, other non-ASCII dropped)."""
    ascii_only = f"regexp_replace(strip_accents({UNESCAPE(x)}), '[^\\x00-\\x7F]', '', 'g')"
    return (f"CASE WHEN ({x}) IS NULL OR ({x}) = '' THEN NULL "
            f"ELSE trim(regexp_replace(upper({ascii_only}), '{_WS}', ' ', 'g')) END")


def FOLD_STRICT(x: str) -> str:
    spaced = f"regexp_replace({UNESCAPE(x)}, '{_WS}', ' ', 'g')"
    upper = f"strip_accents(upper(replace({spaced}, 'ß', 'ss')))"
    kept = f"regexp_replace({upper}, '[^A-Z0-9 ]+', '', 'g')"
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE trim(regexp_replace({kept}, ' +', ' ', 'g')) END"


def PAD(x: str, width: int = 7) -> str:
    return (f"CASE WHEN ({x}) IS NULL OR ({x}) = '' THEN NULL "
            f"WHEN length({x}) >= {width} THEN {x} "
            f"WHEN left({x}, 1) IN ('+', '-') THEN left({x}, 1) || lpad(substr({x}, 2), {width - 1}, '0') "
            f"ELSE lpad({x}, {width}, '0') END")


ZONE = ("CASE o.o_orderkey % 8 WHEN 0 THEN 'America/Sao_Paulo' WHEN 1 THEN 'America/Manaus' "
        "WHEN 2 THEN 'UTC' WHEN 3 THEN '-03:00' WHEN 4 THEN 'GMT+5' WHEN 5 THEN 'Europe/Berlin' "
        "WHEN 6 THEN 'Mars/Base' END")


def UTC_OF(local: str) -> str:
    def region(zone: str) -> str:
        return f"timezone('UTC', timezone('{zone}', {local}))"
    return (f"CASE o.o_orderkey % 8 WHEN 0 THEN {region('America/Sao_Paulo')} WHEN 1 THEN {region('America/Manaus')} "
            f"WHEN 2 THEN {local} WHEN 3 THEN {local} + INTERVAL 3 HOUR WHEN 4 THEN {local} - INTERVAL 5 HOUR "
            f"WHEN 5 THEN {region('Europe/Berlin')} END")


# Raw order rows: the order, an older version of some, an exact copy of some.
RAW_ORDERS = """
ro AS (
  SELECT orders.*, v, CASE WHEN v = 1 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END AS created
  FROM orders, (VALUES (0), (1), (2)) AS t(v)
  WHERE v = 0 OR (v = 1 AND o_orderkey % 13 = 0 AND o_orderkey % 8 < 6) OR (v = 2 AND o_orderkey % 17 = 0))"""

TENTHS = "CAST(floor(abs(s_acctbal) / 10) AS BIGINT)"

# ---- shared CTEs -----------------------------------------------------------------

LINES = """
l0 AS (
  SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity, l_tax,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS value_c,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS discount_c,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS tax_c
  FROM lineitem, (VALUES (0), (1)) AS t(copy)
  WHERE copy = 0 OR (l_linenumber = 1 AND l_orderkey % 6 = 0)),
li AS (
  SELECT *, CASE WHEN l_tax > 0 AND l_quantity > 25 THEN 2 WHEN l_tax > 0 THEN 1 ELSE 0 END AS n_sub,
         CASE WHEN l_tax > 0 THEN tax_c + CASE WHEN l_quantity > 25 THEN 50 ELSE 0 END ELSE 0 END AS sub_value_c,
         CASE WHEN l_tax > 0 THEN tax_c // 10 + CASE WHEN l_quantity > 25 THEN 5 ELSE 0 END ELSE 0 END AS sub_discount_c
  FROM l0),
line_text AS (
  SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':'
         || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ':' || CAST(value_c AS VARCHAR) || ':'
         || CAST(discount_c AS VARCHAR) || ':'
         || CASE WHEN n_sub > 0 THEN CAST(tax_c AS VARCHAR) || '/' || CAST(tax_c // 10 AS VARCHAR) ELSE '' END
         || CASE WHEN n_sub > 1 THEN '+50/5' ELSE '' END AS item
  FROM li),
items_u AS (
  -- identical items of one order count once (grouping by the whole item)
  SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_partkey, value_c, discount_c, n_sub, sub_value_c
  FROM li),
basket_u AS (
  SELECT l_orderkey, count(*) AS n_distinct, sum(value_c) AS value_c, sum(discount_c) AS discount_c
  FROM items_u GROUP BY l_orderkey),
basket_t AS (
  SELECT l_orderkey, string_agg(item, ',' ORDER BY item) AS items_text FROM line_text GROUP BY l_orderkey),
basket AS (
  SELECT li.l_orderkey, min(l_suppkey) AS first_supplier, count(*) AS n_items,
         any_value(u.n_distinct) AS n_distinct, any_value(u.value_c) AS value_c,
         any_value(u.discount_c) AS discount_c, any_value(t.items_text) AS items_text,
         sum(sub_value_c) AS garnish_c, sum(sub_discount_c) AS garnish_discount_c, sum(n_sub) AS n_garnish,
         sum(li.value_c) AS all_value_c,
         max(l_linenumber) AS max_sequence
  FROM li JOIN basket_u u ON u.l_orderkey = li.l_orderkey JOIN basket_t t ON t.l_orderkey = li.l_orderkey
  GROUP BY li.l_orderkey),
parsed AS (
  -- baskets whose JSON text can be parsed
  SELECT * FROM basket WHERE l_orderkey % 23 <> 0),
cust AS (
  SELECT c_custkey, c_name, n_name, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_NAME = "(CASE WHEN o.o_orderkey % 5 = 0 THEN 'José  ' || c.c_name || ' &amp; Cia' ELSE c.c_name END)"
_CITY = "(CASE WHEN o.o_orderkey % 9 = 0 THEN 'São ' || c.n_name ELSE c.n_name END)"
_CONSUMER = "(CASE WHEN c_custkey % 4 = 1 THEN c_name || ' Ção' ELSE c_name END)"
_MERCHANT_CITY = "(CASE WHEN s_suppkey % 4 = 0 THEN n_name || ' d''Été' ELSE n_name END)"

CLEAN_ORDERS = f"""
co AS (
  SELECT o.o_orderkey,
         CASE WHEN o.o_orderkey % 19 <> 0 THEN CAST(o.o_custkey AS VARCHAR) END AS customer_id,
         CASE WHEN o.o_orderkey % 7 <> 0 THEN {FOLD(_NAME)} END AS customer_name,
         CASE WHEN o.o_orderkey % 11 <> 0 THEN {FOLD(_CITY)} END AS delivery_address_city,
         {PAD('CAST(o.o_custkey AS VARCHAR)')} AS delivery_address_external_id,
         c.r_name AS delivery_address_state,
         CAST(b.first_supplier AS VARCHAR) AS merchant_id,
         {UTC_OF('o.o_orderdate')} AS order_created_at_utc,
         CAST(o.o_orderkey AS VARCHAR) AS order_id,
         {R('o.o_totalprice', 2)} AS order_total_amount,
         o.o_orderpriority AS origin_platform,
         CAST(NULL AS VARCHAR) AS order_scheduled_date,
         {ZONE} AS merchant_timezone,
         CAST(p.n_items AS INTEGER) AS n_items, p.items_text, p.n_distinct,
         p.value_c, p.discount_c + p.garnish_discount_c AS discount_c, p.garnish_c, p.n_garnish, p.max_sequence
  FROM orders o
  LEFT JOIN basket b ON b.l_orderkey = o.o_orderkey
  LEFT JOIN parsed p ON p.l_orderkey = o.o_orderkey
  LEFT JOIN cust c ON c.c_custkey = o.o_custkey)"""

CLEAN_MERCHANTS = f"""
cm AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS merchant_id,
         '2018-01-01' AS created_at,
         CASE WHEN s_acctbal >= 0 THEN 'true' ELSE 'false' END AS enabled,
         CAST(s_suppkey % 5 + 1 AS VARCHAR) AS price_range,
         CAST(CASE WHEN s_suppkey % 10 = 9 THEN 100
                   WHEN {TENTHS} <= 300 THEN 30 WHEN {TENTHS} <= 400 THEN 40
                   WHEN {TENTHS} <= 600 THEN 60 WHEN {TENTHS} <= 800 THEN 80
                   ELSE 100 END AS INTEGER) AS average_ticket,
         CAST(s_suppkey % 30 AS VARCHAR) AS takeout_time,
         CAST(s_suppkey % 60 AS VARCHAR) AS delivery_time,
         {R('s_acctbal', 2)} AS minimum_order_value,
         CAST(s_suppkey + 10000 AS VARCHAR) AS merchant_zip_code,
         {FOLD(_MERCHANT_CITY)} AS merchant_city,
         r_name AS merchant_state,
         'XX' AS merchant_country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CLEAN_CONSUMERS = f"""
cc AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
         CASE c_custkey % 3 WHEN 0 THEN 'pt' WHEN 1 THEN 'en' ELSE 'es' END AS language,
         '2018-01-01' AS created_at,
         CASE WHEN c_acctbal >= 0 THEN 'true' ELSE 'false' END AS active,
         {FOLD(_CONSUMER)} AS customer_name,
         CAST(c_nationkey AS VARCHAR) AS customer_phone_area,
         CAST(c_custkey AS VARCHAR) AS customer_phone_number
  FROM customer)"""

ABTEST = """
ab AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
         CASE WHEN c_custkey % 2 = 0 THEN 'control' ELSE 'target' END AS is_target
  FROM customer WHERE c_custkey % 10 <> 9)"""

FACT = """
fact AS (
  SELECT co.order_id, co.order_created_at_utc, co.order_scheduled_date, co.origin_platform,
         co.merchant_timezone,
         coalesce(co.customer_name, cc.customer_name) AS customer_name,
         coalesce(co.delivery_address_city, cm.merchant_city) AS delivery_address_city,
         co.delivery_address_state, co.delivery_address_external_id, co.order_total_amount,
         co.merchant_id, co.customer_id, cc.language, cc.created_at AS consumer_created_at,
         cc.active, cc.customer_phone_area, cc.customer_phone_number,
         cm.created_at AS merchant_created_at, cm.enabled, cm.price_range, cm.average_ticket,
         cm.takeout_time, cm.delivery_time, cm.minimum_order_value, cm.merchant_city,
         cm.merchant_state, cm.merchant_country, ab.is_target AS abtest_group,
         co.n_items, co.items_text, co.n_distinct, co.value_c, co.discount_c, co.garnish_c
  FROM co
  LEFT JOIN cm ON cm.merchant_id = co.merchant_id
  LEFT JOIN cc ON cc.customer_id = co.customer_id
  LEFT JOIN ab ON ab.customer_id = co.customer_id)"""

SEGMENTS = """
opc AS (
  SELECT customer_id, CAST(count(DISTINCT order_id) AS BIGINT) AS orders_total
  FROM fact GROUP BY customer_id),
seg AS (
  SELECT customer_id, orders_total, pct_rank,
         CASE WHEN pct_rank >= 0.9 THEN 'High' WHEN pct_rank >= 0.5 THEN 'Medium' ELSE 'Low' END
           AS customer_segment
  FROM (SELECT customer_id, orders_total,
               CAST(percent_rank() OVER (ORDER BY orders_total) AS DOUBLE) AS pct_rank FROM opc))"""

_V = "coalesce(f.value_c + f.garnish_c, 0)"
BASE = f"""
base AS (
  SELECT f.*, s.customer_segment,
         {R(f'CAST({_V} AS DOUBLE) / 100', 2)} AS item_total_value_sum,
         {R(f'CAST({_V} AS DOUBLE) / coalesce(f.n_distinct, 1) / 100', 2)} AS item_total_value_avg,
         {R('CAST(coalesce(f.discount_c, 0) AS DOUBLE) / 100', 2)} AS total_discount,
         CAST(f.order_created_at_utc AS DATE) AS order_date,
         strftime(date_trunc('week', CAST(f.order_created_at_utc AS DATE)), '%Y-%m-%d') AS week,
         strftime(date_trunc('month', CAST(f.order_created_at_utc AS DATE)), '%Y-%m-%d') AS month,
         concat_ws(' - ', f.merchant_city, f.merchant_state) AS city_state
  FROM fact f LEFT JOIN seg s ON s.customer_id = f.customer_id),
bc AS (
  SELECT *,
         CAST(round(order_total_amount * 100) AS BIGINT) AS rev_c,
         CAST(round(total_discount * 100) AS BIGINT) AS disc_c,
         CAST(round(item_total_value_sum * 100) AS BIGINT) AS isum_c,
         CAST(round(item_total_value_avg * 100) AS BIGINT) AS iavg_c
  FROM base),
top3 AS (
  SELECT city_state, CAST(count(*) AS BIGINT) AS orders FROM base
  GROUP BY city_state ORDER BY orders DESC, city_state ASC LIMIT 3)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


FACT_CTES = (LINES, CLEAN_ORDERS, CLEAN_MERCHANTS, CLEAN_CONSUMERS, ABTEST, FACT)
BASE_CTES = FACT_CTES + (SEGMENTS, BASE)

# ---- per-query statements -----------------------------------------------------------

FACT_COLS = [
    ("order_id", "string"), ("order_created_at_utc", "timestamp"),
    ("order_scheduled_date", "string"), ("origin_platform", "string"),
    ("merchant_timezone", "string"), ("customer_name", "string"),
    ("delivery_address_city", "string"), ("delivery_address_state", "string"),
    ("delivery_address_external_id", "string"), ("order_total_amount", "double"),
    ("items", ITEMS.simpleString()), ("merchant_id", "string"), ("customer_id", "string"),
    ("language", "string"), ("consumer_created_at", "string"), ("active", "string"),
    ("customer_phone_area", "string"), ("customer_phone_number", "string"),
    ("merchant_created_at", "string"), ("enabled", "string"), ("price_range", "string"),
    ("average_ticket", "int"), ("takeout_time", "string"), ("delivery_time", "string"),
    ("minimum_order_value", "double"), ("merchant_city", "string"),
    ("merchant_state", "string"), ("merchant_country", "string"), ("abtest_group", "string"),
]


def _type_group(t: str) -> str:
    return "text" if t in ("string", "boolean") else "float" if t == "double" else "other"


def _null_profile() -> str:
    parts = []
    for name, dtype in FACT_COLS:
        probe = "n_items" if name == "items" else name
        parts.append(f"SELECT '{name}' AS column_name, '{dtype}' AS data_type, "
                     f"'{_type_group(dtype)}' AS type_group, "
                     f"CAST(count(*) FILTER (WHERE {probe} IS NULL) AS BIGINT) AS n_null FROM fact")
    return with_(*FACT_CTES) + "\nUNION ALL\n".join(parts)


def _metrics_select(period: str, grouping: str, src: str) -> str:
    def mean(c: str) -> str:
        return R(f"CAST(sum({c}) AS DOUBLE) / NULLIF(count({c}), 0) / 100", 2)

    def total(c: str) -> str:
        return R(f"CAST(sum({c}) AS DOUBLE) / 100", 2)
    return f"""
  SELECT {grouping}, abtest_group, {period},
         CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_consumers,
         {total('rev_c')} AS total_revenue,
         CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders,
         {mean('rev_c')} AS avg_aov,
         {total('disc_c')} AS total_discount,
         {mean('disc_c')} AS avg_discount,
         {total('isum_c')} AS total_item_value,
         {mean('isum_c')} AS avg_item_value_sum,
         {mean('iavg_c')} AS avg_item_value_avg,
         {R('CAST(count(DISTINCT order_id) AS DOUBLE) / NULLIF(count(DISTINCT customer_id), 0)', 2)}
           AS avg_orders_per_consumer,
         {R('CAST(sum(rev_c) AS DOUBLE) / NULLIF(count(DISTINCT customer_id) * 100, 0)', 2)}
           AS avg_revenue_per_consumer
  FROM {src}
  WHERE abtest_group IS NOT NULL
  GROUP BY {grouping}, abtest_group, {period}"""


_PIVOT = ("avg_orders_per_consumer", "avg_revenue_per_consumer", "avg_aov", "total_discount",
          "avg_discount", "total_item_value", "avg_item_value_sum", "avg_item_value_avg")
_LIFTS = (("orders_lift_pct", "avg_orders_per_consumer"),
          ("revenue_lift_pct", "avg_revenue_per_consumer"), ("aov_lift_pct", "avg_aov"))


def _src(grouping: str) -> str:
    if grouping == "city_state":
        return "(SELECT * FROM bc WHERE city_state IN (SELECT city_state FROM top3)) AS rows_in"
    return "bc"


def _metrics(period: str, grouping: str) -> str:
    return with_(*BASE_CTES) + _metrics_select(period, grouping, _src(grouping))


def _lift(period: str, grouping: str) -> str:
    cols = ",\n         ".join(
        f"max(CASE WHEN abtest_group = '{arm}' THEN {m} END) AS {arm}_{m}"
        for arm in ("control", "target") for m in _PIVOT)
    lifts = ",\n       ".join(
        f"{R(f'(target_{m} - control_{m}) / NULLIF(control_{m}, 0) * 100', 2)} AS {name}"
        for name, m in _LIFTS)
    return (with_(*BASE_CTES, f"\nm AS ({_metrics_select(period, grouping, _src(grouping))})",
                  f"\npv AS (SELECT {period}, {grouping},\n         {cols}\n  FROM m GROUP BY {period}, {grouping})")
            + f"SELECT *,\n       {lifts}\nFROM pv")


USER_METRICS = """
um AS (
  SELECT customer_segment, customer_id, abtest_group,
         CAST(count(order_id) AS BIGINT) AS orders_total,
         CAST(sum(rev_c) AS DOUBLE) / NULLIF(count(rev_c), 0) / 100 AS aov
  FROM bc
  WHERE customer_segment IN ('High', 'Medium', 'Low')
    AND customer_id IS NOT NULL AND abtest_group IS NOT NULL
  GROUP BY customer_segment, customer_id, abtest_group)"""

MOMENTS = """
mom AS (
  SELECT customer_segment, abtest_group,
         CAST(count(orders_total) AS BIGINT) AS n_orders, avg(orders_total) AS mean_orders,
         var_samp(orders_total) AS var_orders,
         CAST(count(aov) AS BIGINT) AS n_aov, avg(aov) AS mean_aov, var_samp(aov) AS var_aov
  FROM um GROUP BY customer_segment, abtest_group)"""

_SIMPSON_N = 6000


def _welch_ctes() -> tuple[str, ...]:
    arms = ("control", "target")
    stats = [f"{s}_{t}" for t in ("orders", "aov") for s in ("n", "mean", "var")]
    side = ",\n         ".join(
        f"max(CASE WHEN abtest_group = '{a}' THEN {s} END) AS {a[0]}_{s}" for a in arms for s in stats)
    sbs = f"\nsbs AS (\n  SELECT customer_segment AS segment,\n         {side}\n  FROM mom GROUP BY customer_segment)"
    pieces = []
    for tag in ("orders", "aov"):
        pieces.append(
            f"SELECT segment, '{tag}' AS metric, c_mean_{tag} - t_mean_{tag} AS diff, "
            f"c_var_{tag} / c_n_{tag} AS qc, t_var_{tag} / t_n_{tag} AS qt, "
            f"c_n_{tag} AS nc, t_n_{tag} AS nt FROM sbs")
    tt = "\ntt AS (\n  " + "\n  UNION ALL ".join(pieces) + ")"
    ok = "nc >= 2 AND nt >= 2 AND qc + qt > 0"
    tv = (f"\ntv AS (\n  SELECT segment, metric,\n"
          f"         CASE WHEN {ok} THEN diff / sqrt(qc + qt) END AS t,\n"
          f"         CASE WHEN {ok} THEN (qc + qt) * (qc + qt) / (qc * qc / (nc - 1) + qt * qt / (nt - 1)) END AS nu\n"
          f"  FROM tt)")
    n = _SIMPSON_N
    dens = (f"exp(lgamma((tv.nu + 1) / 2) - lgamma(tv.nu / 2) - 0.5 * ln(tv.nu * pi()) "
            f"- (tv.nu + 1) / 2 * ln(1 + power(g.i * abs(tv.t) / {n}.0, 2) / tv.nu))")
    weight = f"CASE WHEN g.i = 0 OR g.i = {n} THEN 1 WHEN g.i % 2 = 1 THEN 4 ELSE 2 END"
    pv = (f"\npv AS (\n  SELECT tv.segment, tv.metric, tv.t,\n"
          f"         CASE WHEN tv.t IS NULL THEN NULL ELSE greatest(0.0, 1 - 2 * (abs(tv.t) / {n}.0 / 3) * "
          f"(SELECT sum({weight} * {dens}) FROM range(0, {n + 1}) AS g(i))) END AS p\n  FROM tv)")
    wt = ("\nwt AS (\n  SELECT segment,\n"
          "         max(CASE WHEN metric = 'orders' THEN t END) AS t_stat_orders,\n"
          "         max(CASE WHEN metric = 'orders' THEN p END) AS p_value_orders,\n"
          "         max(CASE WHEN metric = 'aov' THEN t END) AS t_stat_aov,\n"
          "         max(CASE WHEN metric = 'aov' THEN p END) AS p_value_aov\n"
          "  FROM pv GROUP BY segment)")
    return (sbs, tt, tv, pv, wt)


def _welch_test() -> str:
    return (with_(*BASE_CTES, USER_METRICS, MOMENTS, *_welch_ctes())
            + f"SELECT segment, {R('t_stat_orders', 6)} AS t_stat_orders, "
              f"{R('p_value_orders', 6)} AS p_value_orders, {R('t_stat_aov', 6)} AS t_stat_aov, "
              f"{R('p_value_aov', 6)} AS p_value_aov FROM wt")


def _significance() -> str:
    return (with_(*BASE_CTES, USER_METRICS, MOMENTS, *_welch_ctes())
            + f"SELECT segment, {R('p_value_orders', 6)} AS p_value_orders, "
              "CASE WHEN p_value_orders < 0.05 THEN 'Yes' ELSE 'No' END AS orders_significant, "
              f"{R('p_value_aov', 6)} AS p_value_aov, "
              "CASE WHEN p_value_aov < 0.05 THEN 'Yes' ELSE 'No' END AS aov_significant FROM wt")


_DEDUP_TIEBREAK = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                   "l_tax", "l_returnflag", "l_linestatus"]

_CO_COLS = ("customer_id, customer_name, delivery_address_city, delivery_address_external_id, "
            "delivery_address_state, merchant_id, order_created_at_utc, order_id, order_total_amount, "
            "origin_platform, order_scheduled_date, merchant_timezone, n_items, items_text")


def build() -> dict[str, str]:
    fact_with = with_(*FACT_CTES)
    base_with = with_(*BASE_CTES)
    q: dict[str, str] = {}
    q["clean_text"] = f"SELECT doc_id, {FOLD('text')} AS text_clean FROM documents"
    q["clean_text_strict"] = f"SELECT doc_id, {FOLD_STRICT('text')} AS text_clean FROM documents"
    q["clean_text_pages"] = f"SELECT page_id, {FOLD('html')} AS text_clean FROM pages"
    q["pad_external_id"] = (with_(RAW_ORDERS) + f"SELECT CAST(o_orderkey AS VARCHAR) AS order_id, "
                            f"{PAD('CAST(o_custkey AS VARCHAR)')} AS delivery_address_external_id FROM ro")
    q["order_utc"] = (with_(RAW_ORDERS) + "SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id, " + ZONE +
                      f" AS merchant_timezone, {UTC_OF('o.created')} AS order_created_at_utc FROM ro o")
    q["parse_items"] = (with_(LINES, RAW_ORDERS) +
                        "SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id, CAST(b.n_items AS INTEGER) AS n_items, "
                        "CAST(b.n_garnish AS INTEGER) AS n_garnish, CAST(b.all_value_c AS BIGINT) AS value_cents, "
                        "CAST(b.max_sequence AS INTEGER) AS max_sequence "
                        "FROM ro o LEFT JOIN parsed b ON b.l_orderkey = o.o_orderkey")
    q["ticket_bucket"] = (f"SELECT CAST(s_suppkey AS VARCHAR) AS merchant_id, "
                          f"CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE CAST({TENTHS} // 10 AS VARCHAR) || '.' "
                          f"|| CAST({TENTHS} % 10 AS VARCHAR) END AS average_ticket, "
                          f"CAST(CASE WHEN s_suppkey % 10 = 9 THEN 100 WHEN {TENTHS} <= 300 THEN 30 "
                          f"WHEN {TENTHS} <= 400 THEN 40 WHEN {TENTHS} <= 600 THEN 60 "
                          f"WHEN {TENTHS} <= 800 THEN 80 ELSE 100 END AS INTEGER) AS ticket_bucket FROM supplier")
    q["clean_merchants"] = with_(CLEAN_MERCHANTS) + "SELECT * FROM cm"
    q["clean_consumers"] = with_(CLEAN_CONSUMERS) + "SELECT * FROM cc"
    q["clean_orders"] = with_(LINES, CLEAN_ORDERS) + f"SELECT {_CO_COLS} FROM co"
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ["l_shipdate"] + _DEDUP_TIEBREAK)
    q["dedup_latest"] = (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
                         f"(PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn FROM lineitem) "
                         f"WHERE rn = 1")
    q["join_merchants"] = (with_(LINES, CLEAN_ORDERS, CLEAN_MERCHANTS) +
                           "SELECT co.order_id, co.customer_id, co.merchant_id, cm.created_at AS merchant_created_at, "
                           "cm.enabled, cm.price_range, cm.average_ticket, cm.minimum_order_value, "
                           "cm.merchant_city, cm.merchant_state, cm.merchant_country "
                           "FROM co LEFT JOIN cm ON cm.merchant_id = co.merchant_id")
    q["join_consumers"] = (with_(LINES, CLEAN_ORDERS, CLEAN_CONSUMERS) +
                           "SELECT co.order_id, co.customer_id, co.merchant_id, co.customer_name, "
                           "cc.customer_name AS consumer_name, cc.language, cc.created_at AS consumer_created_at, "
                           "cc.active FROM co LEFT JOIN cc ON cc.customer_id = co.customer_id")
    q["join_abtest"] = (with_(LINES, CLEAN_ORDERS, ABTEST) +
                        "SELECT co.order_id, co.customer_id, co.merchant_id, ab.is_target AS abtest_group "
                        "FROM co LEFT JOIN ab ON ab.customer_id = co.customer_id")
    q["order_fact"] = fact_with + "SELECT * EXCLUDE (n_distinct, value_c, discount_c, garnish_c) FROM fact"
    q["dq_report"] = (fact_with +
                      "SELECT *, n_distinct_keys = n_keyed AS key_is_unique, n_null_keys = 0 AS key_never_null, "
                      "n_rows > 0 AS has_rows FROM (SELECT CAST(count(*) AS BIGINT) AS n_rows, "
                      "CAST(count(order_id) AS BIGINT) AS n_keyed, "
                      "CAST(count(DISTINCT order_id) AS BIGINT) AS n_distinct_keys, "
                      "CAST(count(*) FILTER (WHERE order_id IS NULL) AS BIGINT) AS n_null_keys FROM fact)")
    q["dq_report_lines"] = (
        "SELECT *, n_distinct_keys = n_keyed AS key_is_unique, n_null_keys = 0 AS key_never_null, "
        "n_rows > 0 AS has_rows FROM (SELECT CAST(count(*) AS BIGINT) AS n_rows, "
        "CAST(count(*) FILTER (WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL) AS BIGINT) AS n_keyed, "
        "CAST((SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem "
        "WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL)) AS BIGINT) AS n_distinct_keys, "
        "CAST(count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS BIGINT) AS n_null_keys "
        "FROM lineitem)")
    q["null_profile"] = _null_profile()
    seg_with = with_(*FACT_CTES, SEGMENTS)
    q["orders_per_customer"] = seg_with + "SELECT customer_id, orders_total FROM opc"
    q["customer_percent_rank"] = seg_with + "SELECT orders_total, customer_id, pct_rank FROM seg"
    q["customer_segments"] = seg_with + "SELECT orders_total, customer_id, pct_rank, customer_segment FROM seg"
    q["base_with_segment"] = (seg_with + "SELECT f.order_id, f.customer_id, f.abtest_group, s.customer_segment "
                              "FROM fact f LEFT JOIN seg s ON s.customer_id = f.customer_id")
    lines_with = with_(LINES, CLEAN_ORDERS)
    q["explode_items"] = (lines_with +
                          "SELECT co.order_id, l.l_linenumber AS sequence, CAST(l.l_partkey AS VARCHAR) AS external_id, "
                          "l.l_quantity AS quantity, CAST(l.value_c AS VARCHAR) AS value, "
                          "CAST(l.discount_c AS VARCHAR) AS discount, "
                          "CAST(l.n_sub AS INTEGER) AS n_garnish "
                          "FROM co LEFT JOIN li l ON l.l_orderkey = co.o_orderkey AND co.o_orderkey % 23 <> 0")
    subs = ("\nsub AS (SELECT li.*, g FROM li, (VALUES (0), (1), (2)) AS t(g) "
            "WHERE (g = 0 AND n_sub = 0) OR (g > 0 AND g <= n_sub))")
    q["explode_garnish"] = (with_(LINES, CLEAN_ORDERS, subs) +
                            "SELECT co.order_id, l.l_linenumber AS sequence, CAST(l.l_partkey AS VARCHAR) AS external_id, "
                            "CASE l.g WHEN 1 THEN CAST(l.tax_c AS VARCHAR) WHEN 2 THEN '50' END AS garnish_value, "
                            "CASE l.g WHEN 1 THEN CAST(l.tax_c // 10 AS VARCHAR) WHEN 2 THEN '5' END AS garnish_discount "
                            "FROM co LEFT JOIN sub l ON l.l_orderkey = co.o_orderkey AND co.o_orderkey % 23 <> 0")
    v = "coalesce(value_c + garnish_c, 0)"
    q["order_item_metrics"] = (lines_with +
                               f"SELECT order_id, {R(f'CAST({v} AS DOUBLE) / 100', 2)} AS item_total_value_sum, "
                               f"{R(f'CAST({v} AS DOUBLE) / coalesce(n_distinct, 1) / 100', 2)} AS item_total_value_avg, "
                               f"{R('CAST(coalesce(discount_c, 0) AS DOUBLE) / 100', 2)} AS total_discount FROM co")
    q["period_columns"] = (base_with + "SELECT order_id, order_created_at_utc, order_date, week, month, city_state "
                           "FROM base")
    q["ab_distribution"] = (base_with + "SELECT abtest_group, CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers, "
                            "CAST(count(order_id) AS BIGINT) AS total_orders FROM bc GROUP BY abtest_group")
    q["ab_overview"] = (base_with + "SELECT CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders, "
                        "CAST(count(DISTINCT customer_id) AS BIGINT) AS total_customers, "
                        f"{R('CAST(sum(rev_c) AS DOUBLE) / 100', 2)} AS total_revenue, "
                        f"{R('CAST(sum(rev_c) AS DOUBLE) / NULLIF(count(rev_c), 0) / 100', 2)} AS avg_order_amount FROM bc")
    group_cols = ("abtest_group, CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers, "
                  "CAST(count(order_id) AS BIGINT) AS total_orders, ")
    q["ab_group_metrics"] = (base_with + "SELECT " + group_cols +
                             f"{R('CAST(sum(rev_c) AS DOUBLE) / 100', 2)} AS total_revenue, "
                             f"{R('CAST(sum(rev_c) AS DOUBLE) / NULLIF(count(rev_c), 0) / 100', 2)} AS avg_order_amount "
                             "FROM bc GROUP BY abtest_group")
    q["ab_retention"] = (base_with + "SELECT " + group_cols +
                         "CAST(sum(rev_c) AS DOUBLE) / 100 AS total_revenue, "
                         "CAST(sum(rev_c) AS DOUBLE) / NULLIF(count(rev_c), 0) / 100 AS avg_order_amount "
                         "FROM bc GROUP BY abtest_group")
    q["ab_orders_per_customer"] = (
        base_with + "SELECT abtest_group, avg(customer_orders) AS avg_orders_per_customer, "
        "CAST(sum(spent_c) AS DOUBLE) / NULLIF(count(spent_c), 0) / 100 AS avg_revenue_per_customer "
        "FROM (SELECT abtest_group, customer_id, count(order_id) AS customer_orders, sum(rev_c) AS spent_c "
        "FROM bc GROUP BY abtest_group, customer_id) GROUP BY abtest_group")
    q["top_cities"] = base_with + "SELECT * FROM top3"
    q["top_city_orders"] = (base_with + "SELECT order_id, customer_id, abtest_group, city_state, order_date, "
                            "order_total_amount FROM base WHERE city_state IN (SELECT city_state FROM top3)")
    for pname, pcol in (("daily", "order_date"), ("weekly", "week"), ("monthly", "month")):
        for gname, gcol in (("city", "city_state"), ("segment", "customer_segment")):
            q[f"{pname}_{gname}_metrics"] = _metrics(pcol, gcol)
            q[f"{pname}_{gname}_lift"] = _lift(pcol, gcol)
    q["user_metrics"] = with_(*BASE_CTES, USER_METRICS) + "SELECT * FROM um"
    q["welch_moments"] = (with_(*BASE_CTES, USER_METRICS, MOMENTS) +
                          "SELECT customer_segment, abtest_group, n_orders, "
                          f"{R('mean_orders', 6)} AS mean_orders, {R('var_orders', 6)} AS var_orders, n_aov, "
                          f"{R('mean_aov', 6)} AS mean_aov, {R('var_aov', 2)} AS var_aov FROM mom")
    q["welch_test"] = _welch_test()
    q["significance"] = _significance()
    return q


ORACLE_SQL: dict[str, str] = build()
