"""Streams over replayed folders of the logs: the same rows as the batch flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.config import STARTUP_LABEL
from riskloom.operators import cleaning
from riskloom.operators.spaced import Rule
from riskloom.registry import views
from riskloom.registry.core import query
from riskloom.registry.sql_views import with_steps
from riskloom.streaming import days, replay, spaced

U = 'usr as "user"'


@query(with_steps(f"select {U}, day, usb_count, usb_after_hours_flag, usb_on_weekend_flag from device_day", "device_day"))
def streamed_device_days(spark, sf):
    """Connects and flags per user-day, from a stream of the device log."""
    folder = replay.lay_out(views.devices(spark, sf).select("id", "user", "ts", "activity"))
    return replay.replayed(spark, folder, lambda rows: days.device_days(rows, views.CORPUS_VIEW), "streamed-devices")


@query(with_steps(f"select {U}, day, job_site_visits_flag from web_day", "web_day"))
def streamed_web_days(spark, sf):
    """Job-site flag per user-day, from a stream of the web log."""
    folder = replay.lay_out(views.visits(spark, sf).select("id", "user", "ts", "url"))
    return replay.replayed(spark, folder, lambda rows: days.web_days(rows, views.CORPUS_VIEW), "streamed-web")


def _rule(duplicate: float, bounce: float) -> Rule:
    return Rule(int(duplicate * 1e6), int(bounce * 1e6))


@query(with_steps("select id from kept_usb_raw", "kept_usb_raw"))
def streamed_usb_dedup(spark, sf):
    """Device rows left by the last-kept rule, judged in a stream with one state per user and device."""
    events = cleaning.by_source(views.host_events(spark, sf), "UMDF").where(F.col("user").isNotNull() & F.col("device").isNotNull())
    folder = replay.lay_out(events.select("id", "user", "device", "event_id", "ts"))
    settings = views.CLEANING_VIEW
    connect = cleaning.device_category(F.col("event_id")) == "CONNECT"
    rule = _rule(settings.duplicate_seconds, settings.bounce_seconds)
    return replay.replayed(
        spark, folder, lambda rows: spaced.stream_spaced(rows, ["user", "device"], connect, rule), "streamed-usb"
    ).select("id")


@query(with_steps("select id from kept_startup", "kept_startup"))
def streamed_startup_dedup(spark, sf):
    """Startups left by the last-kept rule, judged in a stream with one state per user."""
    events = views.host_events(spark, sf).where(F.col("activity") == STARTUP_LABEL)
    folder = replay.lay_out(events.select("id", "user", "activity", "ts"))
    rule = _rule(views.CLEANING_VIEW.startup_seconds, 0.0)
    return replay.replayed(
        spark, folder, lambda rows: spaced.stream_spaced(rows, ["user"], F.lit(True), rule), "streamed-startups"
    ).select("id")
