"""Date and time columns.

Every time-dependent function takes ``as_of`` (text, ``datetime`` or a
``TIMESTAMP_NTZ`` column) instead of reading the clock, so a plan gives the
same rows when a lost executor makes Spark run a task again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

_MICROS_PER_DAY = 86_400_000_000

# Fixed value: a clock time that ends in an offset, such as "10:00:00+02:00" or "10:00Z".
_OFFSET_TIME = r"\d{1,2}:\d{2}.*([Zz]|[+-]\d{2}:?\d{2})$"

# Fixed value: certificate time format, e.g. "Dec 31 23:59:59 2024 GMT".
_CERT_FORMAT = "MMM d HH:mm:ss yyyy 'GMT'"


def as_of_column(as_of: str | datetime | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


def days_before(as_of: str | datetime | Column, days: int) -> Column:
    """``as_of`` minus whole days; folds to a literal, so filters on it push down."""
    return as_of_column(as_of) - F.expr(f"INTERVAL '{days}' DAY")


def utc_timestamp(text: Column) -> Column:
    """ISO text (date, local time, or time with offset) to UTC ``TIMESTAMP_NTZ``.

    Text without an offset is taken as UTC; unreadable text gives NULL.
    """
    zoned = F.convert_timezone(
        None, F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz")
    )
    return F.when(text.rlike(_OFFSET_TIME), zoned).otherwise(text.try_cast("timestamp_ntz"))


def cert_timestamp(text: Column) -> Column:
    """Certificate validity text to UTC ``TIMESTAMP_NTZ`` (day may be space padded)."""
    single_spaced = F.regexp_replace(text, r"\s+", " ")
    return F.try_to_timestamp(single_spaced, F.lit(_CERT_FORMAT)).cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(_MICROS_PER_DAY))


def domain_age_days(creation_date: Column, as_of: str | datetime | Column) -> Column:
    """Whole days since registration, rounded down."""
    return F.floor(days_between(creation_date, as_of_column(as_of)))


def cert_days_left(cert_valid_to: Column, as_of: str | datetime | Column) -> Column:
    """Whole days until the certificate (text form) runs out, rounded down."""
    return F.floor(days_between(as_of_column(as_of), cert_timestamp(cert_valid_to)))


def utc_instant(moment: Column) -> Column:
    """UTC ``TIMESTAMP_NTZ`` to the instant it names, whatever the session time zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), moment).cast("timestamp")


def utc_wall_time(instant: Column) -> Column:
    """An instant as UTC ``TIMESTAMP_NTZ``, whatever the session time zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
