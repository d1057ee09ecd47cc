"""Clock columns that never pass through the session time zone.

Trip times are local wall-clock values without a zone. ``timestampdiff`` and
``date_trunc`` would cast them to zoned timestamps first and shift hours around
a daylight-saving change, so differences are taken as intervals and truncation
rebuilds the value from its fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end, keeping the fraction."""
    return (end - start).cast("interval second").cast("decimal(18,6)").cast("double")


def journey_minutes(start="pickup_datetime", end="dropoff_datetime") -> Column:
    return elapsed_seconds(F.col(start), F.col(end)) / 60


def duration_hours(start="pickup_datetime", end="dropoff_datetime") -> Column:
    return elapsed_seconds(F.col(start), F.col(end)) / 3600


def pickup_hour(column="pickup_datetime") -> Column:
    return F.hour(column)


def weekday_name(column="pickup_datetime") -> Column:
    """English weekday name, independent of the session locale."""
    names = F.array(*[F.lit(day) for day in WEEKDAYS])
    # element_at takes a NULL index for a known one, hence the guard.
    known = F.col(column).isNotNull()
    return F.when(known, F.element_at(names, F.weekday(F.to_date(column)) + 1))


def truncate_time(column: Column, unit: str) -> Column:
    """Coarsen a timestamp to 'full', 'minute' or 'hour'."""
    if unit == "full":
        return column
    if unit not in ("minute", "hour"):
        raise ValueError("unit must be 'full', 'minute' or 'hour'")
    minute = F.minute(column) if unit == "minute" else F.lit(0)
    return F.make_timestamp_ntz(
        F.year(column), F.month(column), F.day(column), F.hour(column), minute, F.lit(0)
    )


def in_period(column: str, start: str, end: str) -> str:
    """SQL for a half-open period as a plain range, so it reaches the Parquet scan."""
    return f"({column} >= TIMESTAMP_NTZ '{start}' AND {column} < TIMESTAMP_NTZ '{end}')"


def in_year(column: str, year: int) -> str:
    return in_period(column, f"{year}-01-01", f"{year + 1}-01-01")
