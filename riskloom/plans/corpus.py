"""Corpus flow: three logs to one row per user and day, as a single plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import CORPUS, FeatureSettings
from riskloom.operators.assemble import fill_numeric, with_weekly_compound
from riskloom.operators.baseline import with_zscore
from riskloom.operators.daily import (
    connects, daily_logon, daily_with_diversity, device_rows, diversity_rows, logon_rows,
    monthly_diversity, stack, web_rows,
)

SOURCES = ("logon", "device", "web")


def corpus_days(
    logons: DataFrame, devices: DataFrame, visits: DataFrame, settings: FeatureSettings = CORPUS
) -> DataFrame:
    """User-day features. Baselines average over the days that have the source."""
    plugged = connects(devices)
    rows = stack(
        logon_rows(logons, settings),
        device_rows(plugged, settings),
        web_rows(visits, settings),
        diversity_rows(monthly_diversity(plugged, "pc", settings)),
    )
    table = daily_with_diversity(rows, SOURCES)
    for value, source in (("logon_count", "logon"), ("usb_count", "device")):
        table = with_zscore(
            table, value, f"{value}_zscore", settings.min_baseline_days, F.col(f"has_{source}")
        )
    table = fill_numeric(table.drop("logon_count", *[f"has_{s}" for s in SOURCES]))
    return with_weekly_compound(table, usb="usb_count_zscore")


def logon_zscores(logons: DataFrame, settings: FeatureSettings = CORPUS) -> DataFrame:
    """Logon features with the z-score of the daily logon count."""
    return with_zscore(
        daily_logon(logons, settings), "logon_count", "logon_count_zscore", settings.min_baseline_days
    )
