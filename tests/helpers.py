"""Builders shared by the tests."""

from datetime import datetime, timedelta

START = datetime(2024, 1, 1)  # a Monday


def at(seconds: float) -> datetime:
    """Time in seconds after the start."""
    return START + timedelta(microseconds=round(seconds * 1e6))


def rows(df, *columns):
    """Sorted tuples of the named columns."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
