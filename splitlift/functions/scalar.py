"""Scalar column functions: all native Spark expressions (no Python)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ITEMS, ITEMS_LENIENT


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_ZONES: dict[str, tuple[str, ...]] = {}

# Offset forms that a zone may have besides a region name: Z, or a signed offset
# up to 18 hours, on its own or after UTC, GMT or UT.
OFFSET_ZONE = (r"^(?:Z|(?:UTC|GMT|UT)?[+-](?:(?:0?[0-9]|1[0-7])(?::[0-5]?[0-9])?|18(?::0?0)?"
               r"|(?:0[0-9]|1[0-7])[0-5][0-9]|1800))\z")


def known_zones(spark: SparkSession | None = None) -> tuple[str, ...]:
    """Zone names that Spark's JVM accepts: its region ids and short ids. Asked of
    the JVM that plans the query, once per application."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app not in _ZONES:
        jvm = spark.sparkContext._jvm
        zone = jvm.java.time.ZoneId
        names = [jvm.java.lang.String.join(",", ids)
                 for ids in (zone.getAvailableZoneIds(), zone.SHORT_IDS.keySet())]
        _ZONES[app] = tuple(sorted({n for text in names for n in text.split(",")}))
    return _ZONES[app]


def local_to_utc(local_text: Column | str, zone: Column | str) -> Column:
    """Wall-clock text in a per-row zone -> UTC timestamp.

    The zone is a region name or an offset. Malformed text, a NULL zone or an
    unknown zone give NULL instead of failing the job (an unknown zone raises
    inside ``to_utc_timestamp``)."""
    zone = _c(zone)
    ts = F.try_to_timestamp(_c(local_text))
    valid = zone.isin(*known_zones()) | zone.rlike(OFFSET_ZONE)  # a hash lookup per row
    return F.when(valid, F.to_utc_timestamp(ts, F.when(valid, zone).otherwise("UTC")))


def round_half_up(c: Column | str, digits: int = 2) -> Column:
    """Round text or numbers half-up; text that is not a number gives NULL."""
    return F.round(_c(c).try_cast("double"), digits)


def parse_items(c: Column | str, schema: T.DataType = ITEMS, lenient: bool = False) -> Column:
    """JSON text -> typed item array.

    Typed (default): malformed/empty text gives NULL; a single object becomes a
    one-element array. Lenient: money fields as string maps and NULL, empty or
    malformed text gives an empty array."""
    if lenient:
        parsed = F.from_json(_c(c), ITEMS_LENIENT if schema is ITEMS else schema)
        return F.coalesce(parsed, F.array().cast(ITEMS_LENIENT if schema is ITEMS else schema))
    return F.from_json(_c(c), schema)


def step_bucket(c: Column | str, bounds: Sequence[float] = (30, 40, 60, 80),
                last: int = 100) -> Column:
    """First bound the value does not exceed; above all bounds, non-numeric text
    or NULL -> ``last`` (NULL comparisons fall through to the default)."""
    value = _c(c).try_cast("double")
    expr = None
    for bound in bounds:
        cond = value <= F.lit(float(bound))
        expr = F.when(cond, F.lit(int(bound))) if expr is None else expr.when(cond, F.lit(int(bound)))
    return F.lit(int(last)) if expr is None else expr.otherwise(F.lit(int(last)))


def segment_label(rank: Column | str, high: float = 0.90, medium: float = 0.50,
                  labels: tuple[str, str, str] = ("High", "Medium", "Low")) -> Column:
    rank = _c(rank)
    return (F.when(rank >= high, labels[0])
            .when(rank >= medium, labels[1])
            .otherwise(labels[2]))


def week_start_text(date_col: Column | str) -> Column:
    """Monday on or before the date, as yyyy-MM-dd (a Monday maps to itself)."""
    return F.date_format(F.date_trunc("week", _c(date_col)), "yyyy-MM-dd")


def month_start_text(date_col: Column | str) -> Column:
    return F.date_format(F.trunc(_c(date_col), "month"), "yyyy-MM-dd")


def join_text(*cols: Column | str, sep: str = " - ") -> Column:
    """Join with a separator, skipping NULLs; all NULL gives ''."""
    return F.concat_ws(sep, *[_c(c) for c in cols])


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division that yields NULL on a zero or NULL denominator (ANSI-safe)."""
    return F.try_divide(_c(num), _c(den))


def lift_pct(target: Column | str, control: Column | str, digits: int = 2) -> Column:
    """(target - control) / control * 100, rounded; NULL when control is 0/NULL."""
    target, control = _c(target), _c(control)
    return F.round(F.try_divide(target - control, control) * F.lit(100), digits)


def significance_flag(p: Column | str, alpha: float = 0.05) -> Column:
    """'Yes' when p < alpha; NaN or NULL give 'No'."""
    return F.when(_c(p) < F.lit(alpha), "Yes").otherwise("No")


def to_cents(c: Column | str) -> Column:
    """Money with at most two decimals -> exact integer cents (long)."""
    return F.round(_c(c) * F.lit(100)).cast("long")
