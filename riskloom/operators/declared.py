"""Further user-day features: sessions, files, web, mail and their same-day combinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import CalendarSettings, FeatureSettings, HOST
from riskloom.functions.calendar import after_hours, matches, weekend
from riskloom.operators.baseline import with_zscore

# Working hours of the declared session features.
DECLARED_HOURS = CalendarSettings(weekend_days=(5, 6), work_start_hour=8, work_end_hour=18)
# File types that run code or hold archives.
EXECUTABLES = r"\.(exe|bat|ps1)$"
ARCHIVES = r"\.(zip|rar)$"
# Domains for uploads and personal mail.
UPLOAD_DOMAINS = "dropbox|wetransfer"
PERSONAL_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com")
NEVER_USED = 999


def _daily(rows: DataFrame):
    return rows.where(F.col("user").isNotNull() & F.col("ts").isNotNull()).groupBy(
        "user", F.to_date("ts").alias("day")
    )


def _any(flag: Column) -> Column:
    return F.max(F.coalesce(flag.cast("int"), F.lit(0)))


def session_features(logons: DataFrame, calendar: CalendarSettings = DECLARED_HOURS) -> DataFrame:
    """Out-of-hours and weekend rows, logons and distinct machines per user-day."""
    ts = F.col("ts")
    return _daily(logons).agg(
        F.max(after_hours(ts, calendar)).alias("after_hours_session"),
        F.max(weekend(ts, calendar.weekend_days)).alias("weekend_session"),
        F.count_if(F.col("activity") == "Logon").alias("logon_count_day"),
        F.count_distinct("pc").alias("pc_count_day"),
    )


def days_since_last_usb(days: DataFrame, connects: DataFrame) -> DataFrame:
    """Calendar days since the user's latest connect day; never connected gives 999."""
    used = connects.where(F.col("ts").isNotNull()).select(
        "user", F.to_date("ts").alias("day"), F.lit(True).alias("used")
    ).groupBy("user", "day").agg(F.max("used").alias("used"))
    upto = Window.partitionBy("user").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("used"), F.col("day")), ignorenulls=True).over(upto)
    marked = days.select("user", "day", F.lit(True).alias("wanted")).join(used, ["user", "day"], "full")
    return (
        marked.withColumn("days_since_last_usb", F.coalesce(F.date_diff("day", last), F.lit(NEVER_USED)))
        .where("wanted").select("user", "day", "days_since_last_usb")
    )


def file_features(files: DataFrame, settings: FeatureSettings = HOST) -> DataFrame:
    """Files, distinct extensions, executable, archive and off-hours flags per user-day."""
    extension = F.nullif(F.lower(F.regexp_extract("filename", r"\.([^.\\/]+)$", 1)), F.lit(""))
    return _daily(files).agg(
        F.count("filename").alias("file_count_day"),
        F.count_distinct(extension).alias("unique_extensions_day"),
        F.max(matches(F.col("filename"), EXECUTABLES)).alias("executable_access_flag"),
        F.max(matches(F.col("filename"), ARCHIVES)).alias("archive_creation_flag"),
        F.max(after_hours(F.col("ts"), settings.calendar)).alias("off_hours_file_access"),
    )


def web_features(visits: DataFrame, settings: FeatureSettings = HOST) -> DataFrame:
    """Distinct domains, upload flag, job visits and off-hours flag per user-day."""
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    upload = (F.col("method") == "POST") | host.rlike(f"(?i)(?:{UPLOAD_DOMAINS})")
    return _daily(visits).agg(
        F.count_distinct(host).alias("domains_visited_day"),
        _any(upload).alias("upload_activity_flag"),
        F.sum(matches(F.col("url"), settings.job_pattern)).alias("job_site_visits"),
        F.max(after_hours(F.col("ts"), settings.calendar)).alias("off_hours_browsing"),
    )


def email_features(
    emails: DataFrame, own_domains: Sequence[str], settings: FeatureSettings = HOST
) -> DataFrame:
    """Mail volume, attachment size, external share, personal flag, off-hours flag, z-score.

    Mails are counted before their recipients are unfolded; a mail's size counts once.
    """
    mails = _daily(emails).agg(
        F.count(F.lit(1)).alias("emails_sent_day"),
        (F.sum("size_bytes") / F.lit(1_000_000.0)).alias("attachment_size_total"),
        F.max(after_hours(F.col("ts"), settings.calendar)).alias("after_hours_email"),
    )
    domain = F.lower(F.substring_index("recipient", "@", -1))
    recipients = _daily(
        emails.select("user", "ts", F.explode("recipients").alias("recipient"))
    ).agg(
        F.avg((~domain.isin(*own_domains)).cast("double")).alias("external_email_ratio"),
        _any(domain.isin(*PERSONAL_DOMAINS)).alias("personal_domain_flag"),
    )
    daily = mails.join(recipients, ["user", "day"], "left")
    return with_zscore(daily, "emails_sent_day", "emails_sent_zscore", settings.min_baseline_days)


def usb_with_after_hours_file(
    connects: DataFrame, files: DataFrame, settings: FeatureSettings = HOST
) -> DataFrame:
    """User-days with a connect and a file access outside working hours."""
    outside = after_hours(F.col("ts"), settings.calendar) == 1
    rows = connects.where(outside).select("user", "ts", F.lit(1).alias("usb"), F.lit(0).alias("file")).unionByName(
        files.where(outside).select("user", "ts", F.lit(0).alias("usb"), F.lit(1).alias("file"))
    )
    return _daily(rows).agg(
        (F.max("usb") * F.max("file")).alias("usb_plus_afterhours_file")
    )


def external_email_with_archive(file_days: DataFrame, email_days: DataFrame) -> DataFrame:
    """1 on user-days with a new archive and mail to an external or personal address."""
    sent = (F.col("external_email_ratio") > 0) | (F.col("personal_domain_flag") == 1)
    both = (F.col("archive_creation_flag") == 1) & sent
    return file_days.join(email_days, ["user", "day"], "full").select(
        "user", "day",
        F.coalesce(both, F.lit(False)).cast("int").alias("external_email_plus_archive"),
    )


def multistation_with_usb(session_days: DataFrame, usb_days: DataFrame) -> DataFrame:
    """1 on user-days with logons on several machines and a connect."""
    both = (F.col("pc_count_day") > 1) & (F.col("usb_count") > 0)
    return session_days.join(usb_days, ["user", "day"], "full").select(
        "user", "day", F.coalesce(both, F.lit(False)).cast("int").alias("multistation_plus_usb")
    )
