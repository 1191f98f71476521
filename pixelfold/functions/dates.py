"""Temporal strings and calendar windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted temporal notations (fixed patterns).
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
YEAR = r"^\d{4}$"
TIME = r"^\d{2}:\d{2}:\d{2}([Zz]|[+-]\d{2}:\d{2})?$"


def temporal_kind(col) -> Column:
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    return (
        F.when(text.isNull(), "open")
        .when(text.rlike(DATE_TIME), "date-time")
        .when(text.rlike(DATE), "date")
        .when(text.rlike(YEAR), "year")
        .when(text.rlike(TIME), "time")
        .otherwise("invalid")
    )


def temporal_instant(col) -> Column:
    """Instant of a date-time, date or year string; NULL for anything else."""
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    return (
        F.when(text.rlike(DATE_TIME), F.try_to_timestamp(F.upper(text)))
        .when(text.rlike(DATE), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z"))))
        .when(text.rlike(YEAR), F.try_to_timestamp(F.concat(text, F.lit("-01-01T00:00:00Z"))))
    )


def temporal_seconds(col) -> Column:
    """Second of the day of a time string."""
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    part = lambda start: F.substring(text, start, 2).try_cast("int")
    seconds = part(1) * 3600 + part(4) * 60 + part(7)
    return F.when(text.rlike(TIME), seconds)


def in_doy_range(date: Column, low: int, high: int) -> Column:
    """Day-of-year window; ``low > high`` runs across the year end."""
    if not (1 <= low <= 366 and 1 <= high <= 366):
        raise ValueError("day of year must lie in 1..366")
    doy = F.dayofyear(date)
    return doy.between(low, high) if low <= high else (doy >= low) | (doy <= high)


def day_number(date) -> Column:
    return F.unix_date(F.col(date) if isinstance(date, str) else date)
