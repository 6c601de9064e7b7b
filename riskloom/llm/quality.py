"""Quality scores of documents by an additive model of their form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.batches import bounded_rows
from riskloom.llm.features import FEATURES, text_features
from riskloom.llm.gam import AdditiveModel, fit_additive

# Bound of the labelled rows that a model is fitted to: those with the smallest hashes.
TRAINING_ROWS = 30_000
KEEP_AT = 0.3


def with_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features) of every row; texts are read whole."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_rows(parts, 1):
            values = np.array([text_features(t) for t in part.column(1).to_pylist()]).reshape(-1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values, pa.float64()), len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column(0), lists.cast(pa.list_(pa.float64()))], [key, "features"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(batches, f"{key} {kind}, features array<double>")


def is_held_out(key: Column, parts: int = 5, part: int = 0) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    max_rows: int = TRAINING_ROWS,
) -> AdditiveModel:
    """Fit to labelled rows outside the held-out part.

    At most ``max_rows`` labelled rows, those with the smallest hashes of key and label, are
    used; the bound is the same at every size. Labels other than 0 and 1 are left out.
    A document with several labels counts once for each.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~is_held_out(F.col(key)) & F.col(key).isNotNull()).select(
        F.col(key).alias("__key"), F.col(label).cast("double").alias("y")
    )
    # The broadcast is of numbers only and bounded: max_rows times 16 bytes.
    chosen = F.broadcast(known.orderBy(F.xxhash64("__key"), "__key", "y").limit(max_rows))
    rows = (
        with_features(docs.join(chosen.select(F.col("__key").alias(key)).distinct(), key, "left_semi"), key, text)
        .join(chosen, F.col(key) == F.col("__key"))
        .select(key, "y", "features").toArrow()
    )
    features = rows.column("features").combine_chunks()
    x = np.asarray(features.flatten()).reshape(-1, len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)))
    y, keys = np.asarray(rows.column("y")), np.asarray(rows.column(key))
    order = np.lexsort((*x.T[::-1], y, keys))
    return fit_additive(x[order], y[order])


def quality_scores(
    docs: DataFrame, model: AdditiveModel, key: str = "doc_id", text: str = "text",
    keep: tuple[str, ...] = (), threshold: float = KEEP_AT, names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """key, the ``keep`` columns, score and predicted (or the ``names`` given) of every row.

    Null and empty texts are scored like any other, from features that are all 0.
    """
    columns = [key, *[c for c in keep if c != key]]
    schema = docs.select(*columns).schema.add(names[0], "double").add(names[1], "integer")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_rows(parts, len(columns)):
            x = np.array([text_features(t) for t in part.column(part.num_columns - 1).to_pylist()])
            score = model.score(x.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                [*columns, *names],
            )

    return docs.select(*columns, F.col(text).alias("__text")).mapInArrow(batches, schema)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    model = fit_quality(docs, labels, key, text)
    scored = quality_scores(docs, model, key, text, tuple(docs.columns), names=("__score", "__predicted"))
    return scored.where("__predicted = 1").select(*docs.columns)
