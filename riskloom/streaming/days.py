"""Daily features of live logs: one row per user and day once the watermark has passed it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import CORPUS, FeatureSettings
from riskloom.functions.calendar import after_hours, matches, shift_days, weekend
from riskloom.streaming.replay import CLOSING, event_time


def stream_days(rows: DataFrame, builds: dict, delay: str = "2 hours") -> DataFrame:
    """Aggregate rows (user, ts, ...) to user-days of event time.

    A day is given once, when no row of it can come any more: rows that are later than ``delay`` are
    left out. State holds one row per user and open day.
    """
    timed = rows.where(F.col("user").isNotNull()).withColumn("__at", event_time(F.col("ts"))).withWatermark("__at", delay)
    # The closing row is told by an aggregate: a filter on the user would keep it from the watermark.
    closing = F.max(F.col("user") == CLOSING).alias("__closing")
    days = timed.groupBy("user", F.window("__at", "1 day")).agg(closing, *[b.alias(n) for n, b in builds.items()])
    day = F.date_from_unix_date(F.floor(F.unix_micros("window.start") / 86_400_000_000).cast("int"))
    return days.where(~F.col("__closing")).select("user", day.alias("day"), *builds)


def device_days(devices: DataFrame, settings: FeatureSettings = CORPUS, delay: str = "2 hours") -> DataFrame:
    """Connect count and flags per user-day, as ``daily_device`` has them."""
    calendar = settings.calendar
    moved = devices.where((F.col("activity") == "Connect") | (F.col("user") == CLOSING)).withColumn(
        "ts", shift_days(F.col("ts"), calendar.shift_days)
    )
    return stream_days(moved, {
        "usb_count": F.count("activity"), "usb_after_hours_flag": F.max(after_hours(F.col("ts"), calendar)),
        "usb_on_weekend_flag": F.max(weekend(F.col("ts"), calendar.weekend_days)),
    }, delay)


def web_days(visits: DataFrame, settings: FeatureSettings = CORPUS, delay: str = "2 hours") -> DataFrame:
    """Job-site flag per user-day, as ``daily_web`` has it."""
    moved = visits.withColumn("ts", shift_days(F.col("ts"), settings.calendar.shift_days))
    return stream_days(moved, {"job_site_visits_flag": F.max(matches(F.col("url"), settings.job_pattern))}, delay)
