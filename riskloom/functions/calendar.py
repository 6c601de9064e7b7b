"""Time, keyword and duration expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.config import CalendarSettings

# Microseconds from 1601-01-01 to 1970-01-01.
EPOCH_1601_MICROS = 11_644_473_600_000_000


def lenient_timestamp(text: Column, fmt: str | None = None) -> Column:
    """Parse a timestamp; text that does not parse becomes null."""
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def lenient_day(text: Column, fmt: str = "MM/dd/yyyy") -> Column:
    """Parse a day; text that does not parse becomes null."""
    return lenient_timestamp(text, fmt).cast("date")


def shift_days(ts: Column, days: int) -> Column:
    """Move a timestamp by whole days, before anything is derived from it."""
    return ts + F.make_interval(days=F.lit(days)) if days else ts


def utc_from_zone(ts: Column, zone: str | None) -> Column:
    """Judge hours and days in ``zone`` instead of UTC when one is given."""
    return F.from_utc_timestamp(ts, zone) if zone else ts


def after_hours(ts: Column, calendar: CalendarSettings) -> Column:
    """1 outside working hours, 0 inside or when the time is unknown."""
    hour = F.hour(ts)
    outside = (hour < calendar.work_start_hour) | (hour >= calendar.work_end_hour)
    return F.coalesce(outside, F.lit(False)).cast("int")


def weekend(ts: Column, days: Iterable[int]) -> Column:
    """1 when the weekday (0 is Monday) is listed, 0 otherwise."""
    return F.coalesce(F.weekday(ts).isin(*days), F.lit(False)).cast("int")


def matches(text: Column, pattern: str) -> Column:
    """1 when the pattern occurs anywhere in the text, ignoring case; null counts as 0."""
    return F.coalesce(text.rlike(f"(?i)(?:{pattern})"), F.lit(False)).cast("int")


def micros(ts: Column) -> Column:
    """Microseconds since 1970; naive timestamps are read in the session zone."""
    return F.unix_micros(ts.cast("timestamp"))


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from start to end as a double."""
    return (micros(end) - micros(start)) / F.lit(60_000_000.0)


def from_webkit_micros(value: Column) -> Column:
    """Microseconds since 1601 to a timestamp; 0 and null become null."""
    return F.timestamp_micros(F.when(value != 0, value - F.lit(EPOCH_1601_MICROS)))


def from_unix_micros(value: Column) -> Column:
    """Microseconds since 1970 to a timestamp; 0 and null become null."""
    return F.timestamp_micros(F.when(value != 0, value))


def month_of(day: Column) -> Column:
    """First day of the month."""
    return F.trunc(day, "MM")
