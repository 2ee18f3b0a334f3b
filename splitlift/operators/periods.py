"""Calendar columns and the city label used by the period reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import join_text, month_start_text, week_start_text


def add_periods(df: DataFrame, ts: str = "order_created_at_utc", city: str = "merchant_city",
                state: str = "merchant_state") -> DataFrame:
    """order_date (date), week and month (first day, yyyy-MM-dd text) and
    ``city_state`` = city ' - ' state (NULL parts skipped, '' if both NULL)."""
    order_date = F.to_date(F.col(ts))
    return df.withColumns({
        "order_date": order_date,
        "week": week_start_text(order_date),
        "month": month_start_text(order_date),
        "city_state": join_text(city, state),
    })
