"""User-day features: sources are tagged, stacked and aggregated in one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import CORPUS, FeatureSettings
from riskloom.functions.calendar import after_hours, matches, month_of, shift_days, weekend
from riskloom.operators.sessions import pair_adjacent

KEYS = ["user", "day"]


def _tagged(rows: DataFrame, source: str) -> DataFrame:
    """Name the source and drop rows that belong to no user-day."""
    return rows.withColumn("source", F.lit(source)).where(
        F.col("user").isNotNull() & F.col("day").isNotNull()
    )


def logon_rows(logons: DataFrame, settings: FeatureSettings = CORPUS) -> DataFrame:
    """Logon and logoff rows ready for the daily aggregate; pairing precedes the day cut."""
    calendar = settings.calendar
    shifted = logons.withColumn("ts", shift_days(F.col("ts"), calendar.shift_days))
    ts = F.col("ts")
    return _tagged(
        pair_adjacent(shifted, settings).select(
            "user", F.to_date(ts).alias("day"), "session_minutes",
            after_hours(ts, calendar).cast("long").alias("after_hours"),
            weekend(ts, calendar.weekend_days).alias("weekend"),
            F.coalesce(F.col("activity") == "Logon", F.lit(False)).cast("long").alias("logons"),
        ),
        "logon",
    )


def connects(devices: DataFrame) -> DataFrame:
    """Rows that report a device being plugged in."""
    return devices.where(F.col("activity") == "Connect")


def device_rows(
    devices: DataFrame, settings: FeatureSettings = CORPUS, counted: str = "activity"
) -> DataFrame:
    """Connect rows ready for the daily aggregate; a row counts when ``counted`` is not null."""
    calendar = settings.calendar
    ts = shift_days(F.col("ts"), calendar.shift_days)
    return _tagged(
        devices.select(
            "user", F.to_date(ts).alias("day"),
            F.col(counted).isNotNull().cast("long").alias("usb"),
            after_hours(ts, calendar).alias("usb_after_hours"),
            weekend(ts, calendar.weekend_days).alias("usb_weekend"),
        ),
        "device",
    )


def web_rows(visits: DataFrame, settings: FeatureSettings = CORPUS) -> DataFrame:
    """Web rows ready for the daily aggregate."""
    ts = shift_days(F.col("ts"), settings.calendar.shift_days)
    return _tagged(
        visits.select(
            "user", F.to_date(ts).alias("day"),
            matches(F.col("url"), settings.job_pattern).alias("job"),
        ),
        "web",
    )


def monthly_diversity(
    devices: DataFrame, column: str, settings: FeatureSettings = CORPUS, approximate: bool = False
) -> DataFrame:
    """Distinct machines or devices per user and month; the column decides which signal it is."""
    ts = shift_days(F.col("ts"), settings.calendar.shift_days)
    distinct = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return (
        devices.where(F.col("user").isNotNull() & ts.isNotNull())
        .groupBy("user", month_of(ts).cast("date").alias("month"))
        .agg(distinct.alias("usb_device_diversity_monthly"))
    )


def attach_monthly(daily: DataFrame, diversity: DataFrame) -> DataFrame:
    """Give each device day the value of its user and month."""
    return (
        daily.withColumn("month", month_of(F.col("day")).cast("date"))
        .join(diversity, ["user", "month"], "left").drop("month")
    )


def stack(*parts: DataFrame) -> DataFrame:
    """Union of sources with different columns; what a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# Daily aggregate of each source. The flag tells a day without the source (null)
# from a day on which the source counted nothing (0).
_DAILY = {
    "logon": {
        "total_active_minutes_day": lambda: F.coalesce(F.sum("session_minutes"), F.lit(0.0)),
        "after_hours_session_count": lambda: F.sum("after_hours"),
        "weekend_session_flag": lambda: F.max("weekend"),
        "logon_count": lambda: F.sum("logons"),
    },
    "device": {
        "usb_count": lambda: F.sum("usb"),
        "usb_after_hours_flag": lambda: F.max("usb_after_hours"),
        "usb_on_weekend_flag": lambda: F.max("usb_weekend"),
    },
    "web": {"job_site_visits_flag": lambda: F.max("job")},
}


def daily_activity(
    rows: DataFrame, sources: tuple[str, ...], unknown_minutes: bool = False, *more: Column
) -> DataFrame:
    """Aggregate stacked rows to user-days, the full outer combination of the sources.

    ``unknown_minutes`` keeps a null total null instead of reading it as 0.
    """
    seen = {s: F.count_if(F.col("source") == s) > 0 for s in sources}
    builds = {n: (s, b) for s in sources for n, b in _DAILY[s].items()}
    if unknown_minutes:
        builds["total_active_minutes_day"] = ("logon", lambda: F.sum("session_minutes"))
    return rows.groupBy(*KEYS).agg(
        *[F.when(seen[s], build()).alias(name) for name, (s, build) in builds.items()],
        *[seen[s].alias(f"has_{s}") for s in sources], *more,
    )


def daily_logon(logons: DataFrame, settings: FeatureSettings = CORPUS) -> DataFrame:
    """Session minutes, after-hours rows, weekend flag and logon count per user-day."""
    return daily_activity(logon_rows(logons, settings), ("logon",)).drop("has_logon")


def daily_device(devices: DataFrame, settings: FeatureSettings = CORPUS) -> DataFrame:
    """Connect count and flags per user-day."""
    return daily_activity(device_rows(connects(devices), settings), ("device",)).drop("has_device")


def daily_web(visits: DataFrame, settings: FeatureSettings = CORPUS) -> DataFrame:
    """Job-site flag per user-day."""
    return daily_activity(web_rows(visits, settings), ("web",)).drop("has_web")


def diversity_rows(diversity: DataFrame) -> DataFrame:
    """Monthly values as rows of their month's first day, to travel with the stacked sources."""
    return diversity.select(
        "user", F.col("month").alias("day"), "usb_device_diversity_monthly",
        F.lit("month").alias("source"),
    )


def daily_with_diversity(
    rows: DataFrame, sources: tuple[str, ...], unknown_minutes: bool = False
) -> DataFrame:
    """Daily aggregate plus the user's monthly diversity on device days.

    The monthly value rides in the same shuffle and is spread by a window over
    (user, month), which reuses the per-user clustering of the baselines.
    """
    carried = F.max("usb_device_diversity_monthly").alias("__monthly")
    daily = daily_activity(rows, sources, unknown_minutes, carried).repartition("user")
    month = Window.partitionBy("user", month_of(F.col("day")))
    spread = F.when(F.col("has_device"), F.max("__monthly").over(month))
    any_source = reduce(lambda a, b: a | b, [F.col(f"has_{s}") for s in sources])
    return (
        daily.withColumn("usb_device_diversity_monthly", spread).where(any_source).drop("__monthly")
    )
