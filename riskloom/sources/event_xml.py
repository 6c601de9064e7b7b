"""Host events from their XML text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import SECURITY_LABELS, SYSTEM_LABELS
from riskloom.schemas import EVENT_XML

MISSING_DEVICE = "N/A"
MISSING_LOGON = "n/a"
OTHER_ACTIVITY = "OTHER"
# Where an event of a file starts (its root element has a longer name) and ends.
EVENT_START, EVENT_END = r"(?=<Event[\s>])", "</Event>"


def activity_label(event_id: Column, labels: Mapping[int, str], default: str = OTHER_ACTIVITY) -> Column:
    """Activity of an event id, or the default."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, event_id), F.lit(default))


def log_activity(source: Column, event_id: Column) -> Column:
    """Activity of an event id within its log."""
    return F.when(source == "Security", activity_label(event_id, SECURITY_LABELS)).when(
        source == "System", activity_label(event_id, SYSTEM_LABELS)
    )


def _parsed(raw: DataFrame, xml: str) -> DataFrame:
    # As an element of an array, which conditions on what was parsed are not pushed through: they would parse again.
    return raw.withColumn("__x", F.explode(F.array(F.from_xml(F.col(xml), EVENT_XML))))


def device_events(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """Device events: id, time and device instance, whichever element holds the instance."""
    kept = [c for c in raw.columns if c != xml]
    # Arrivals and requests wrap it in elements of different names and depths. Broken text, which
    # leaves the event id unknown, is not searched.
    held = F.xpath_string(F.col(xml), F.lit("//*[local-name()='InstanceId']"))
    instance = F.when(F.col("__x.System.EventID").isNotNull(), F.nullif(held, F.lit("")))
    return _parsed(raw, xml).select(
        *kept, F.lit("UMDF").alias("source"), F.col("__x.System.EventID").alias("event_id"),
        F.try_to_timestamp("__x.System.TimeCreated._SystemTime").alias("ts"),
        F.coalesce(instance, F.lit(MISSING_DEVICE)).alias("device"),
    )


def security_events(raw: DataFrame, xml: str = "xml", source: str = "source") -> DataFrame:
    """Security and system events: id, time, activity and logon id."""
    kept = [c for c in raw.columns if c != xml]
    named = F.filter("__x.EventData.Data", lambda d: d["_Name"] == "TargetLogonId")
    event_id = F.col("__x.System.EventID")
    return _parsed(raw, xml).select(
        *kept, event_id.alias("event_id"),
        F.try_to_timestamp("__x.System.TimeCreated._SystemTime").alias("ts"),
        log_activity(F.col(source), event_id).alias("activity"),
        # Without the item the logon id is a fixed text; the last item of the name counts.
        F.coalesce(F.try_element_at(named, F.lit(-1))["_VALUE"], F.lit(MISSING_LOGON)).alias("logon_id"),
    )


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """Events of exported XML files, a row per ``Event`` element: file and xml.

    Files (UTF-8, with or without a root element) are read as records that end where an event ends, so a large file is
    split among tasks and an event that is cut off spoils no other: it is a row of its own that does not parse (see
    ``broken_events``). Text between events is left out.
    """
    records = spark.read.text(path, lineSep=EVENT_END).select(F.col("_metadata.file_path").alias("file"), "value")
    opened = F.filter(F.split("value", EVENT_START), lambda part: part.rlike(EVENT_START))
    # Only the last event that a record opens is the one that it ends.
    pieces = F.transform(opened, lambda part, k: F.when(k == F.size(opened) - 1, F.concat(part, F.lit(EVENT_END))).otherwise(part))
    return records.select("file", F.explode(pieces).alias("xml"))


def readable_events(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows whose text parses to an event with an id."""
    return _parsed(raw, xml).where(F.col("__x.System.EventID").isNotNull()).drop("__x")


def broken_events(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows of each file whose text does not parse: file, rows and the first 200 characters of one of them."""
    broken = _parsed(raw, xml).where(F.col("__x.System.EventID").isNull())
    return broken.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min(F.substring(xml, 1, 200)).alias("example"))
