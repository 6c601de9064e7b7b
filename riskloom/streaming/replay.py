"""Folders of events as streams: laid out in time order, and replayed to the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.calendar import micros
from riskloom.plans.materialise import new_path, stored

# The user of a row that only says that time has passed; no result holds it.
CLOSING = "\x00closing"
_DAY = 86_400_000_000
FILE_ROWS = 1_000_000


def event_time(ts) -> F.Column:
    """The time of an event as an instant whose days are those of UTC."""
    return F.timestamp_micros(micros(ts))


def lay_out(events: DataFrame, slices: int = 4, closing_days: int = 3) -> str:
    """Write dated events as files in time order, one after the other, and a last row that closes the log.

    There are ``slices`` files of equal spans of time, or as many as keep them at about ``FILE_ROWS`` rows. The last row lies ``closing_days`` after all others under the user ``CLOSING``: it moves the watermark
    past them, as later events do in a live stream. Returns the folder.
    """
    spark = events.sparkSession
    rows = stored(events.where(F.col("ts").isNotNull()).withColumn("__us", micros(F.col("ts"))), "stream-rows")
    first, last, n = rows.agg(F.min("__us"), F.max("__us"), F.count(F.lit(1))).first()
    slices = max(slices, -(-n // FILE_ROWS))
    path = new_path(spark, "stream")
    if first is None:
        rows.drop("__us").write.parquet(path)
        return path
    step = max(1, -(-(last - first + 1) // slices))
    for k in range(slices):
        part = rows.where((F.col("__us") >= first + k * step) & (F.col("__us") < first + (k + 1) * step))
        part.drop("__us").coalesce(1).write.mode("append").parquet(path)
    kind = dict(rows.dtypes)["ts"]
    end = F.timestamp_micros(F.lit(last + closing_days * _DAY)).cast(kind)
    closing = spark.range(1).select(F.lit(CLOSING).alias("user"), end.alias("ts"))
    empty = rows.drop("__us").where("false")
    empty.unionByName(closing, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    return path


def replayed(
    spark: SparkSession, folder: str, build: Callable[[DataFrame], DataFrame], name: str, files: int = 1
) -> DataFrame:
    """Run a stream over all files that a folder holds now, ``files`` at a time, and read what it wrote.

    Checkpoints and results lie in the shared folder; a run that is stopped goes on where it was.
    """
    schema = spark.read.parquet(folder).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    out = build(source)
    path = new_path(spark, name)
    query = (
        out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{path}-state").start(path)
    )
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
