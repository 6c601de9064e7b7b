"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and reads it back as the next stage's docs. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import exact, jaccard, mixing, packing, quality
from riskloom.plans.materialise import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop what the quality classifier rejects; it learns from ``docs`` and the labels."""
    return quality.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one of the documents with equal texts."""
    return exact.drop_exact_duplicates(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one of each group of similar documents."""
    return jaccard.drop_similar(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix to the sources' weights takes them."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram jaccard join", dissimilar_documents),
    ("source mix", mixed_documents),
    ("best-fit packing", packed_sequences),
]

# A fitted model and token ids are beyond SQL; tests hold run() to a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages in turn, from the documents table; its last stage's rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), "pipeline-" + name.replace(" ", "-"))
    return docs
