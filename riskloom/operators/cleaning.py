"""Host-log noise filters, including the "last kept" rules whose outcome depends on order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import (
    CleaningSettings, DEVICE_CONNECT_ID, STARTUP_LABEL, USB_DEVICE_PATTERN,
)
from riskloom.functions.calendar import micros
from riskloom.operators.cells import CELL, carried_from, cell_window, sliced
from riskloom.operators.spaced import Rule, spaced_rows
from riskloom.plans.materialise import stored


def by_source(events: DataFrame, *sources: str) -> DataFrame:
    """Rows of the named sources."""
    return events.where(F.col("source").isin(*sources))


def usb_only(events: DataFrame, pattern: str = USB_DEVICE_PATTERN) -> DataFrame:
    """Keep device rows whose id matches; rows of other sources pass."""
    is_device = F.col("source").eqNullSafe("UMDF")
    known = F.coalesce(F.col("device"), F.lit("")).rlike(f"(?i){pattern}")
    return events.where(~is_device | known)


def within_lookback(events: DataFrame, as_of: Column, days: int, keep_undated: bool = False) -> DataFrame:
    """Keep rows no older than ``days`` before ``as_of``, which is always an argument."""
    recent = F.col("ts") >= as_of - F.make_interval(days=F.lit(days))
    if keep_undated:
        recent = recent | F.col("ts").isNull()
    return events.where(recent)


def device_category(event_id: Column) -> Column:
    """CONNECT for the arrival event, DISCONNECT for every other."""
    return F.when(event_id == DEVICE_CONNECT_ID, "CONNECT").otherwise("DISCONNECT")


def keep_spaced(
    events: DataFrame, keys: Sequence[str], connect: Column,
    duplicate_seconds: float, bounce_seconds: float, settings: CleaningSettings = CleaningSettings(),
) -> DataFrame:
    """Drop repeats and bounces of the last kept row of the same key.

    A row is dropped when it has the kind of the last kept row and follows it within
    ``duplicate_seconds``, or when it is no connect and follows a kept connect in less
    than ``bounce_seconds``. ``id`` (a long) identifies a row and orders equal times.
    Rows without a time or a key are kept. One way serves bursts of any length.
    """
    loose = F.col("ts").isNull()
    for key in keys:
        loose = loose | F.col(key).isNull()
    rule = Rule(int(duplicate_seconds * 1e6), int(bounce_seconds * 1e6))
    kept = spaced_rows(events.where(~loose), keys, connect, rule, settings.slice_rows, settings.slice_fan)
    return kept.unionByName(events.where(loose))


def usb_dedup(
    events: DataFrame, keys: Sequence[str] = ("user", "device"),
    settings: CleaningSettings = CleaningSettings(),
) -> DataFrame:
    """Annotate device rows with a category and drop bursts and phantom bounces.

    Rows of other sources pass. The state is kept per user and device, so logs of
    several hosts can share a table.
    """
    device = by_source(events, "UMDF").withColumn("category", device_category(F.col("event_id")))
    others = events.where(~F.col("source").eqNullSafe("UMDF"))
    kept = keep_spaced(
        device, keys, F.col("category") == "CONNECT",
        settings.duplicate_seconds, settings.bounce_seconds, settings,
    )
    return kept.unionByName(others, allowMissingColumns=True)


def startup_dedup(
    events: DataFrame, keys: Sequence[str] = ("user",), label: str = STARTUP_LABEL,
    settings: CleaningSettings = CleaningSettings(),
) -> DataFrame:
    """Keep a startup only when it follows the last kept one by more than the window."""
    is_startup = F.col("activity").eqNullSafe(label)
    kept = keep_spaced(
        events.where(is_startup), keys, F.lit(True), settings.startup_seconds, 0.0, settings
    )
    return kept.unionByName(events.where(~is_startup))


def without_boot_logons(
    events: DataFrame, keys: Sequence[str] = ("user",), startup: str = STARTUP_LABEL,
    logon: str = "LOGON", settings: CleaningSettings = CleaningSettings(),
) -> DataFrame:
    """Drop logons within the window after the last startup; run after ``startup_dedup``.

    The last startup of earlier slices serves logons that precede their slice's first one.
    """
    reach = int(settings.startup_seconds * 1e6)
    is_logon = F.col("activity").eqNullSafe(logon)
    is_startup = F.col("activity").eqNullSafe(startup)
    rows = sliced(
        events.where((is_logon | is_startup) & F.col("ts").isNotNull()).select(
            *keys, "id", micros(F.col("ts")).alias("__t"), is_startup.alias("__startup")
        ), keys, ["__t", "id"], settings.slice_rows,
    )
    started = F.when(F.col("__startup"), F.col("__t"))
    upto = cell_window(keys, [F.col("__t"), F.col("id")]).rowsBetween(Window.unboundedPreceding, 0)
    noise = (
        rows.join(carried_from(rows, keys, F.max(started), "__before", "previous"), [*keys, CELL], "left")
        .withColumn("__last", F.coalesce(F.last(started, ignorenulls=True).over(upto), F.col("__before")))
        .where(~F.col("__startup") & (F.col("__t") - F.col("__last") <= reach))
        .select(*keys, "id")
    )
    kept = events.where(is_logon).join(noise, [*keys, "id"], "left_anti")
    return kept.unionByName(events.where(~is_logon))


def clean_host_log(
    events: DataFrame, pattern: str = USB_DEVICE_PATTERN,
    settings: CleaningSettings = CleaningSettings(),
) -> DataFrame:
    """Boot noise, then foreign devices, then device bursts; the result is written once.

    Device rows carry no activity, so the boot rules and the device rules each read
    only their own rows.
    """
    devices = usb_dedup(usb_only(by_source(events, "UMDF"), pattern), settings=settings)
    others = startup_dedup(events.where(~F.col("source").eqNullSafe("UMDF")), settings=settings)
    quiet = without_boot_logons(others, settings=settings)
    return stored(devices.unionByName(quiet, allowMissingColumns=True), "clean-host-log")
