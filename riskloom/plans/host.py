"""Host flow: raw host events to the fixed user-day table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import CleaningSettings, FeatureSettings, HOST, USB_DEVICE_PATTERN
from riskloom.functions.calendar import utc_from_zone
from riskloom.operators.assemble import (
    fill_numeric, host_day_schema, with_weekly_compound, without_empty_days,
)
from riskloom.operators.baseline import with_zscore
from riskloom.operators.cleaning import by_source, clean_host_log
from riskloom.operators.daily import (
    daily_with_diversity, device_rows, diversity_rows, monthly_diversity, stack, web_rows,
)
from riskloom.operators.sessions import host_session_days
from riskloom.plans.materialise import stored
from riskloom.sources.event_xml import device_events, security_events
from riskloom.sources.logs import browser_events, union_sources

SOURCES = ("logon", "device", "web")


def host_rows(events: DataFrame, settings: FeatureSettings = HOST) -> DataFrame:
    """Session days, connects and visits, stacked for the daily aggregate."""
    devices = by_source(events, "UMDF").where(F.col("category") == "CONNECT")
    sessions = host_session_days(by_source(events, "Security", "System"), settings).select(
        "user", "day", F.lit("logon").alias("source"),
        F.col("total_active_minutes_day").alias("session_minutes"),
        F.col("after_hours_session_count").alias("after_hours"),
        F.col("weekend_session_flag").alias("weekend"), F.col("logon_count").alias("logons"),
    )
    return stack(
        sessions,
        device_rows(devices, settings, counted="device"),
        web_rows(by_source(events, "Browser"), settings),
        diversity_rows(monthly_diversity(devices, "device", settings)),
    )


def host_days(
    events: DataFrame, settings: FeatureSettings = HOST, zone: str | None = None
) -> DataFrame:
    """User-day features of cleaned host events, in the fixed column order.

    Hours and days are judged in ``zone``, UTC by default.
    """
    events = events.withColumn("ts", utc_from_zone(F.col("ts"), zone))
    table = daily_with_diversity(host_rows(events, settings), SOURCES, unknown_minutes=True)
    for value, source in (("logon_count", "logon"), ("usb_count", "device")):
        table = with_zscore(
            table, value, f"{value}_zscore", settings.min_baseline_days, F.col(f"has_{source}")
        )
    table = without_empty_days(table.drop("logon_count", *[f"has_{s}" for s in SOURCES]))
    table = fill_numeric(table, keep_null=["total_active_minutes_day"])
    return host_day_schema(with_weekly_compound(table, usb="usb_count"))


def host_report_days(
    events: DataFrame, pattern: str = USB_DEVICE_PATTERN, features: FeatureSettings = HOST,
    cleaning: CleaningSettings = CleaningSettings(),
) -> DataFrame:
    """Raw events to features: noise filters first."""
    return host_days(clean_host_log(events, pattern, cleaning), features)


def exported_host_log(
    device_xml: DataFrame, session_xml: DataFrame, visits: DataFrame, as_of: Column, days: int
) -> DataFrame:
    """Exported device XML, session XML (with its ``source``) and browser visits as one host log.

    Rows without a time belong to no day and are left out; ``days`` limits the visits. The log is written once: XML
    is parsed here and by none of the steps that follow.
    """
    log = union_sources(
        device_events(device_xml), security_events(session_xml), browser_events(visits, as_of, days)
    )
    return stored(log.where(F.col("ts").isNotNull()), "exported-log")
