"""Saved settings, baselines and models."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from riskloom.operators.envelope import EnvelopeModel, Scaler
from riskloom.operators.isolation import IsolationModel


def save_settings(rows: DataFrame, path: str) -> None:
    """Write a table of a few rows (thresholds, baselines) as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def load_settings(spark: SparkSession, path: str) -> DataFrame | None:
    """Read saved settings, or None when they are missing."""
    try:
        return spark.read.json(path)
    except AnalysisException:
        return None


def save_forest(model: PipelineModel, path: str) -> None:
    """Write the forest and its feature list."""
    model.write().overwrite().save(path)


def load_forest(path: str) -> PipelineModel:
    """Read a saved forest; a missing path fails."""
    return PipelineModel.load(path)


def save_isolation(model: IsolationModel, path: str) -> None:
    """Write the node table and the few scalars beside it."""
    spark = model.nodes.sparkSession
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame(
        [(model.features, model.sample, float(model.offset))],
        "features array<string>, sample int, offset double",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_isolation(spark: SparkSession, path: str) -> IsolationModel:
    """Read a saved isolation forest."""
    row = spark.read.parquet(f"{path}/settings").first()
    return IsolationModel(
        spark.read.parquet(f"{path}/nodes"), list(row["features"]), row["sample"], row["offset"]
    )


def save_envelope(spark: SparkSession, model: EnvelopeModel, path: str) -> None:
    """Write the envelope's vectors and matrix as one row."""
    spark.createDataFrame(
        [(model.scaler.features, model.scaler.mean, model.scaler.scale,
          model.mean.tolist(), model.precision.tolist(), float(model.offset))],
        "features array<string>, centre array<double>, scale array<double>, "
        "mean array<double>, matrix array<array<double>>, offset double",
    ).coalesce(1).write.mode("overwrite").parquet(path)


def load_envelope(spark: SparkSession, path: str) -> EnvelopeModel:
    """Read a saved envelope."""
    row = spark.read.parquet(path).first()
    scaler = Scaler(list(row["features"]), list(row["centre"]), list(row["scale"]))
    return EnvelopeModel(scaler, np.array(row["mean"]), np.array(row["matrix"]), row["offset"])
