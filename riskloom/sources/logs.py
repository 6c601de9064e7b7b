"""Log readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.config import UNIFIED_COLUMNS
from riskloom.functions.calendar import (
    from_unix_micros, from_webkit_micros, lenient_day, lenient_timestamp, micros,
)
from riskloom.schemas import FEATURE_CSV, INCIDENTS, UNIFIED_LOG

OFFSET_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSSZ"


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read CSV with a header and an explicit schema; empty text is null, a missing path fails."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_log(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "MM/dd/yyyy HH:mm:ss"
) -> DataFrame:
    """Read a logon, device or web log; ``ts`` is the parsed ``date``, null when it does not parse."""
    log = read_csv(spark, path, schema)
    return log.withColumn("ts", lenient_timestamp(F.col("date"), fmt)).drop("date")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Read a user-day table written as CSV; ``day`` becomes a date."""
    table = read_csv(spark, path, FEATURE_CSV)
    return table.withColumn("day", lenient_day(F.col("day"))).withColumn("date", F.col("day"))


def read_incidents(spark: SparkSession, path: str, fmt: str = "MM/dd/yyyy HH:mm:ss") -> DataFrame:
    """Read incident intervals; ends that do not parse are null."""
    rows = read_csv(spark, path, INCIDENTS)
    return rows.withColumns({c: lenient_timestamp(F.col(c), fmt) for c in ("start", "end")})


def read_unified(spark: SparkSession, path: str) -> DataFrame:
    """Read the unified host log; offset-aware times become UTC."""
    log = read_csv(spark, path, UNIFIED_LOG)
    return log.withColumn("ts", lenient_timestamp(F.col("timestamp"), OFFSET_FORMAT)).drop("timestamp")


def to_unified(events: DataFrame) -> DataFrame:
    """The fixed columns of the unified log, times written with their offset."""
    written = events.withColumn("timestamp", F.date_format(F.col("ts").cast("timestamp"), OFFSET_FORMAT))
    return written.select(*[
        F.col(c) if c in written.columns else F.lit(None).cast("string").alias(c)
        for c in UNIFIED_COLUMNS
    ])


def union_sources(*sources: DataFrame) -> DataFrame:
    """Stack event tables with different columns."""
    first, *rest = sources
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def chronological(events: DataFrame) -> DataFrame:
    """Sort by time, for a sink; range-partitioned, not one task."""
    return events.orderBy(F.col("ts").asc_nulls_last(), "id")


def browser_events(visits: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Exported browser visits as events.

    Firefox counts microseconds from 1970 and keeps visited pages, even undated ones;
    the others count from 1601 and keep dated pages.
    """
    firefox = F.col("browser") == "Firefox"
    ts = F.when(firefox, from_unix_micros(F.col("visit_us"))).otherwise(from_webkit_micros(F.col("visit_us")))
    visited = F.when(firefox, F.col("visit_count") > 0).otherwise(F.col("visit_us") > 0)
    oldest = micros(as_of) - F.lit(days * 86_400 * 1_000_000)
    recent = ts.isNull() | (micros(ts) >= oldest)
    kept = [c for c in visits.columns if c not in ("visit_us", "title")]
    return visits.where(visited & recent).select(
        *kept, ts.alias("ts"), F.coalesce("title", F.lit("")).alias("title"),
        F.lit("Browser").alias("source"),
    )


def write_csv(table: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Write chosen columns as CSV."""
    chosen = table.select(*columns) if columns else table
    chosen.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_days(table: DataFrame, path: str) -> None:
    """Write a user-day table partitioned by month, so day filters skip folders."""
    month = F.date_format("day", "yyyy-MM")
    (
        table.withColumn("month", month).repartition("month", "user")
        .write.mode("overwrite").partitionBy("month").parquet(path)
    )
