"""Reliable materialisation in the shared folder the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Rows of a part of a table that fits go through many times.
PART_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``. Where nothing is named, a session
    inside one process gets a folder of its own; on a cluster that folder would be seen by the driver
    alone, so this fails instead.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        one_process = context.master == "local" or context.master.startswith("local[")
        if named is None and not one_process:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="riskloom-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/riskloom/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows once and cut the lineage; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def even_parts(rows: int, cores: int) -> int:
    """The least multiple of the cores that leaves at most ``PART_ROWS`` rows to a part."""
    return cores * max(1, -(-rows // (PART_ROWS * cores)))


def stored(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """Write the rows as parquet in the shared folder and read them back.

    Later passes prune columns and push filters into the written table. ``spread``
    cuts it into parts of at most about ``PART_ROWS`` rows, as many for each core, for
    tables that fits go through many times: adaptive execution would merge a narrow
    table into few large parts, and a part more than the cores have room for at once makes every pass wait
    for a second round of tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    if not spread:
        return written
    parts = even_parts(written.count(), spark.sparkContext.defaultParallelism)
    again = new_path(spark, name)
    written.repartition(parts).write.parquet(again)
    return spark.read.schema(df.schema).parquet(again)
