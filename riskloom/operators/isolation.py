"""Isolation forest: bounded keyed samples, one small tree per group, vectorised scoring."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import DetectorSettings
from riskloom.operators.assemble import imputed
from riskloom.operators.ordering import exact_quantiles
from riskloom.plans.materialise import stored

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, length double"
)
RAW = "__iso_raw"


def mean_depth(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points: the published normaliser."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def keyed_samples(
    table: DataFrame, features: Sequence[str], key: Sequence[str], rows: int,
    settings: DetectorSettings,
) -> DataFrame:
    """At most ``isolation_sample`` rows per tree, drawn by hash of key, tree and seed.

    A row draws its trees with a probability that makes the expected sample half again
    as large as needed, by geometric skips from tree to tree: a row costs one hash, and one more for each tree that
    draws it. The smallest hashes are kept. The result is bounded by trees x sample rows however large the table is.
    """
    share = min(1.0, 1.5 * settings.isolation_sample / max(rows, 1))
    trees = settings.isolation_trees
    each = [F.col(k) for k in key]

    def skipped(turn) -> Column:
        """Trees passed over before the next one that the row is drawn for: geometric, from one hash."""
        even = (F.pmod(F.xxhash64(*each, turn, F.lit(settings.seed)), F.lit(1 << 53)) + 1) / float(1 << 53)
        return F.floor(F.log(even) / math.log1p(-share)).cast("long") if share < 1 else F.lit(0).cast("long")

    def next_tree(state: Column, turn: Column) -> Column:
        at = state["at"] + 1 + skipped(turn)
        return F.when(state["at"] >= trees, state).otherwise(F.struct(
            at.alias("at"), F.when(at < trees, F.concat(state["drawn"], F.array(at))).otherwise(state["drawn"]).alias("drawn")
        ))

    first_tree = F.struct(F.col("__first").alias("at"), F.array(F.col("__first")).alias("drawn"))
    drawn = (
        # One hash tells for almost every row of a large table that no tree draws it.
        table.withColumn("__first", skipped(F.lit(0))).where(F.col("__first") < trees)
        .withColumn("tree", F.explode(F.aggregate(
            F.sequence(F.lit(1), F.lit(trees)), first_tree, next_tree, lambda state: state["drawn"]
        )))
        .withColumn("tree", F.col("tree").cast("int"))
        .withColumn("__h", F.xxhash64(*each, "tree", F.lit(settings.seed + 1)))
        .select("tree", "__h", *features)
    )
    first = Window.partitionBy("tree").orderBy("__h")
    return (
        drawn.withColumn("__r", F.row_number().over(first))
        .where(F.col("__r") <= settings.isolation_sample).drop("__r")
    )


def _grow(x: np.ndarray, seed: int) -> list[tuple]:
    """Random splits until rows are alone, alike, or log2(sample) deep."""
    rng = np.random.default_rng(seed)
    deepest = math.ceil(math.log2(max(len(x), 2)))
    nodes: list = []
    pending = [(np.arange(len(x)), 0, -1, 0)]
    while pending:
        rows, depth, parent, side = pending.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = here
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= deepest or len(rows) < 2 or not len(open_features):
            nodes.append([here, -1, 0.0, -1, -1, depth + float(mean_depth(len(rows)))])
            continue
        feature = int(rng.choice(open_features))
        cut = float(rng.uniform(low[feature], high[feature]))
        if cut >= high[feature]:  # neighbouring doubles
            cut = float(low[feature])
        nodes.append([here, feature, cut, -1, -1, 0.0])
        goes_left = part[:, feature] <= cut
        pending.append((rows[~goes_left], depth + 1, here, 1))
        pending.append((rows[goes_left], depth + 1, here, 0))
    return nodes


def fit_trees(
    table: DataFrame, features: Sequence[str], key: Sequence[str], rows: int,
    settings: DetectorSettings,
) -> DataFrame:
    """Node table of the forest, built one tree per group of bounded size."""
    names, seed = list(features), settings.seed

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__h")
        tree = int(pdf["tree"].iloc[0])
        nodes = _grow(pdf[names].to_numpy(dtype=float), seed * 1_000_003 + tree)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "length"])
        return out.assign(tree=tree)[
            ["tree", "node", "feature", "threshold", "left", "right", "length"]
        ]

    return keyed_samples(table, features, key, rows, settings).groupBy("tree").applyInPandas(
        grow, NODE_SCHEMA
    )


def _complete(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees as complete binary trees: feature and threshold of inner places, length of the lowest ones, a row a tree.

    Place p has its children at 2p + 1 and 2p + 2. Whichever way a row takes below a leaf, it ends at the leaf's length.
    """
    trees = []
    for _, part in nodes.groupby("tree"):
        own = {c: part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "length")}
        placed, pending = [], [(0, 0, 0)]
        while pending:
            node, place, depth = pending.pop()
            placed.append((node, place, depth))
            if own["feature"][node] >= 0:
                pending += [(own["left"][node], 2 * place + 1, depth + 1), (own["right"][node], 2 * place + 2, depth + 1)]
        trees.append((own, placed))
    deepest = max(depth for _, placed in trees for _, _, depth in placed)
    feature = np.zeros((len(trees), (1 << deepest) - 1), np.int64)
    threshold = np.zeros(feature.shape)
    length = np.zeros((len(trees), 1 << deepest))
    for t, (own, placed) in enumerate(trees):
        for node, place, depth in placed:
            if own["feature"][node] >= 0:
                feature[t, place], threshold[t, place] = own["feature"][node], own["threshold"][node]
            else:
                first = (place + 1 << deepest - depth) - (1 << deepest)
                length[t, first:first + (1 << deepest - depth)] = own["length"][node]
    return feature, threshold, length


def _total_length(x: np.ndarray, trees: tuple[np.ndarray, np.ndarray, np.ndarray], block: int = 16_384) -> np.ndarray:
    """Path lengths of rows, summed over complete trees in their order; all rows of a block go down a tree together."""
    out = np.zeros(len(x))
    for begin in range(0, len(x), block):
        values = np.ascontiguousarray(x[begin:begin + block]).ravel()
        total = out[begin:begin + block]
        base = np.arange(len(total)) * x.shape[1]
        at, cell = np.empty(len(total), np.int64), np.empty(len(total), np.int64)
        seen, cut, left = np.empty(len(total)), np.empty(len(total)), np.empty(len(total), bool)
        for feature, threshold, length in zip(*trees):
            at.fill(0)
            for _ in range((len(length) - 1).bit_length()):
                np.take(feature, at, out=cell, mode="clip")
                np.add(cell, base, out=cell)
                np.take(values, cell, out=seen, mode="clip")
                np.take(threshold, at, out=cut, mode="clip")
                np.less_equal(seen, cut, out=left)
                np.add(at, 1, out=at)
                np.multiply(at, 2, out=at)
                np.subtract(at, left, out=at)
            np.subtract(at, len(feature), out=at)
            np.take(length, at, out=seen, mode="clip")
            total += seen
    return out


@dataclass
class IsolationModel:
    """Node table (at most trees x (2 sample - 1) rows), sample size and offset."""

    nodes: DataFrame
    features: list[str]
    sample: int
    offset: float = 0.0

    def with_raw_score(self, table: DataFrame) -> DataFrame:
        """Add the negated anomaly score in (-1, 0); low is anomalous."""
        nodes = self.nodes.toPandas().sort_values(["tree", "node"])  # bounded, see the class
        shared = table.sparkSession.sparkContext.broadcast(_complete(nodes))
        scale = float(mean_depth(self.sample)) or 1.0

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            total = _total_length(x, shared.value)
            return pd.Series(-np.power(2.0, -total / len(shared.value[0]) / scale))

        return table.withColumn(RAW, score(*[
            F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features
        ]))

    def decide(self, raw: DataFrame) -> DataFrame:
        """Score minus offset, and -1 below zero."""
        score = F.col(RAW) - F.lit(self.offset)
        return raw.withColumns({
            "iso_score": score, "iso_prediction": F.when(score < 0, -1).otherwise(1)
        }).drop(RAW)

    def transform(self, table: DataFrame) -> DataFrame:
        """Score a table with the fitted trees and offset."""
        return self.decide(self.with_raw_score(table))


def fit_isolation(
    table: DataFrame, features: Sequence[str], key: Sequence[str] = ("user", "day"),
    settings: DetectorSettings = DetectorSettings(),
) -> tuple[IsolationModel, DataFrame]:
    """Fit on all rows; returns the model and the table with its scores.

    The offset is the contamination quantile of the scores, which are written once.
    """
    table = imputed(table, features)
    rows = table.count()
    nodes = stored(fit_trees(table, features, key, rows, settings), "isolation-nodes")
    model = IsolationModel(nodes, list(features), min(settings.isolation_sample, rows))
    raw = stored(model.with_raw_score(table), "isolation-scores")
    model.offset = exact_quantiles(raw, {"s": RAW}, {"q": ("s", settings.contamination)}).first()["q"]
    return model, model.decide(raw)
