"""Logs in the engine's shapes, derived by Spark from the given tables.

Every view covers all rows of its event types. SQL twins are in ``sql_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import CalendarSettings, CleaningSettings, FeatureSettings
from riskloom.operators.cleaning import device_category

# The fixture pages hold no career site; this pattern matches some of their hosts.
JOB = r"example\.org"
CORPUS_VIEW = FeatureSettings(calendar=CalendarSettings(shift_days=-1), job_pattern=JOB)
HOST_VIEW = FeatureSettings()
# Events of one user and device are hours apart, so the windows are hours long too.
CLEANING_VIEW = CleaningSettings(
    duplicate_seconds=24 * 3600, bounce_seconds=16 * 3600, startup_seconds=3600
)
DEVICE_VIEW_PATTERN = "^USB_VID_"
VERSION = "4.2"
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; naive times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id")).alias("user"),
        F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _code(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def logons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logon log: id, user, ts, pc, activity."""
    kind = F.col("event_type")
    return _events(spark, sf_dir).where(kind.isin("signup", "error")).select(
        "id", "user", "ts", _code("pc", F.col("k") % 7).alias("pc"),
        F.when(kind == "signup", "Logon").otherwise("Logoff").alias("activity"),
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device log: id, user, ts, pc, activity."""
    kind = F.col("event_type")
    return _events(spark, sf_dir).where(kind.isin("purchase", "view")).select(
        "id", "user", "ts", _code("pc", F.col("k")).alias("pc"),
        F.when(kind == "purchase", "Connect").otherwise("Disconnect").alias("activity"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web log: id, user, ts, url, method. Clicks are spread over all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = pages.agg(F.count(F.lit(1))).scalar()
    clicks = _events(spark, sf_dir).where(F.col("event_type") == "click")
    return clicks.withColumn("page_id", F.col("id") % n).join(pages, "page_id").select(
        "id", "user", "ts", "url", F.when(F.col("k") % 4 == 0, "POST").otherwise("GET").alias("method")
    )


def host_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified host log: id, user, ts, source, event_id, activity, device, url."""
    kind, k = F.col("event_type"), F.col("k")
    click = kind == "click"
    return _events(spark, sf_dir).select(
        "id", "user", "ts",
        F.when(kind == "purchase", "UMDF").when(click & (k >= 50), "Browser")
        .when(click, "Security").otherwise("System").alias("source"),
        F.when((kind == "purchase") & (k % 2 == 0), 2003).when(kind == "purchase", 2100)
        .when(kind == "signup", 6005).when(kind == "view", 107).when(kind == "error", 1074)
        .when(click & (k < 25), 4624).when(click & (k < 50), 4800).alias("event_id"),
        F.when(kind == "signup", "LOGON(STARTUP)").when(kind == "view", "WAKE")
        .when(kind == "error", "LOGOFF(shutdown)").when(click & (k < 25), "LOGON")
        .when(click & (k < 50), "LOCK").alias("activity"),
        F.when(kind != "purchase", None).when(k % 6 < 2, "USB_VID_0").when(k % 6 < 4, "USB_VID_1")
        .otherwise("PCI_0").alias("device"),
        F.when(click & (k >= 50), F.concat(
            F.lit("https://"), F.when(k % 3 == 0, "career").otherwise("news"),
            F.lit(".example.com/"), k.cast("string"),
        )).alias("url"),
    )


def categorised(events: DataFrame) -> DataFrame:
    """Host events with the device category, not yet cleaned."""
    return events.withColumn(
        "category", F.when(F.col("source") == "UMDF", device_category(F.col("event_id")))
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident intervals: users with an extreme value, for a week from its day."""
    kind = F.col("event_type")
    users = _events(spark, sf_dir).groupBy("user").agg(
        F.max("value").alias("top"), F.max_by(F.to_date("ts"), F.struct("value", "id")).alias("start"),
        F.count_if(kind == "view").alias("views"), F.count_if(kind == "click").alias("clicks"),
    )
    return users.where(F.col("top") > 220).select(
        "user", F.when(F.col("views") >= F.col("clicks"), VERSION).otherwise("5.2").alias("dataset"),
        (F.col("clicks") % 3 + 1).cast("int").alias("scenario"),
        "start", F.date_add("start", 6).alias("end"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogate detector outputs, one per event, for the operators that take scores."""
    value, k = F.col("value"), F.col("k")
    return _events(spark, sf_dir).select(
        "id", "user", F.to_date("ts").alias("day"),
        (-value / 97).alias("iso_score"), (-value * value / 997).alias("lof_score"),
        F.when(value < 1, value).otherwise(1 / value).alias("supervised_score"),
        F.when(value > 100, -1).otherwise(1).alias("iso_prediction"),
        F.when((value > 150) | (value < 1), -1).otherwise(1).alias("lof_prediction"),
        (k % 2).cast("int").alias("is_synthetic"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("job_site_visits_flag"),
        ((k - 50) / 17).alias("usb_count_zscore"),
        F.when(value > 120, 1).otherwise(0).alias("insider_label"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File log: id, user, ts, filename."""
    k = F.col("k")
    kind = (
        F.when(k % 9 == 0, ".exe").when(k % 9 == 1, ".zip").when(k % 2 == 0, ".pdf").otherwise(".docx")
    )
    return _events(spark, sf_dir).where(F.col("event_type") == "view").select(
        "id", "user", "ts", F.concat(_code("f", k), kind).alias("filename")
    )


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail log: id, user, ts, recipients, size in bytes."""
    k = F.col("k")
    first = (
        F.when(k % 5 == 0, "a@gmail.com").when(k % 5 == 1, "b@partner.example").otherwise("c@corp.example")
    )
    second = F.when(k % 3 == 0, "d@corp.example")
    return _events(spark, sf_dir).where(F.col("event_type") == "click").select(
        "id", "user", "ts", F.array_compact(F.array(first, second)).alias("recipients"),
        (F.round(F.col("value") * 100).cast("long") * 10).alias("size_bytes"),
    )


def browser_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported browser visits with the browsers' own clocks; some are undated or unvisited."""
    k, micros = F.col("k"), F.unix_micros("ts")
    firefox = k % 2 == 0
    return _events(spark, sf_dir).where(F.col("event_type") == "click").select(
        "id", "user", F.when(firefox, "Firefox").otherwise("Chrome").alias("browser"),
        _code("https://site.example.com/", k).alias("url"),
        F.when(k % 3 != 0, _code("Page ", k)).alias("title"), (k % 4).alias("visit_count"),
        F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, F.lit(0))
        .when(firefox, micros).otherwise(micros + 11_644_473_600_000_000).cast("long").alias("visit_us"),
    )


def event_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host events as XML text, items missing now and then: id, user, source, xml."""
    k = F.col("k")
    events = host_events(spark, sf_dir).join(
        _events(spark, sf_dir).select("id", "k"), "id"
    ).where(F.col("source") != "Browser")
    wrapped = lambda opening, closing: F.concat(
        F.lit(f"<UserData>{opening}<InstanceId>"), F.col("device"), F.lit(f"</InstanceId>{closing}</UserData>")
    )
    arrival = wrapped(
        "<UMDFHostDeviceArrivalBegin xmlns='http://www.microsoft.com/DriverFrameworks/UserMode/Event'>",
        "</UMDFHostDeviceArrivalBegin>",
    )
    request = wrapped("<UMDFHostDeviceRequest><Request>", "</Request></UMDFHostDeviceRequest>")
    instance = F.when(k % 4 == 3, "").when(k % 4 == 2, request).otherwise(arrival)
    data = F.when(k % 5 != 0, F.concat(
        F.lit('<EventData><Data Name="TargetLogonId">0x'), k.cast("string"),
        F.lit('</Data><Data Name="IpPort">0</Data></EventData>'),
    )).otherwise('<EventData><Data Name="IpPort">0</Data></EventData>')
    body = F.when(F.col("source") == "UMDF", instance).otherwise(data)
    xml = F.concat(
        F.lit("<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><EventID>"),
        F.coalesce(F.col("event_id").cast("string"), F.lit("9999")),
        F.lit("</EventID><TimeCreated SystemTime='"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("'/></System>"), body,
        F.lit("</Event>"),
    )
    return events.select("id", "user", "source", xml.alias("xml"))
