"""Per-feature attributions of the forest score, exact for trees of bounded depth.

A leaf answers with its value when the row meets the leaf's path, so the forest is a
sum of leaf terms and its Shapley values are the sum of the leaves' own. A path of
depth d tests at most d features; which of them the row meets is one of 2^d patterns.
The values of every leaf and pattern are tabulated once from the node table, and so is what each
interval between a feature's cuts adds to the patterns; a row needs one lookup per feature and one per
leaf. The tables' size depends on the forest alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.supervised import features_of, forest_of
from riskloom.plans.materialise import new_path


def forest_nodes(table: DataFrame, model: PipelineModel) -> DataFrame:
    """Node table of a fitted forest, read from its saved form."""
    spark = table.sparkSession
    path = new_path(spark, "forest")
    forest_of(model).save(path)
    node = F.col("nodeData")
    weight = F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, b: a + b)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        weight.alias("cover"), (F.get(node["impurityStats"], F.lit(1)) / weight).alias("value"),
    )


def _leaf_paths(nodes: pd.DataFrame):
    """For each leaf: its value and, per tested feature, interval and share of cover."""
    leaves = []
    for _, tree in nodes.groupby("tree"):
        by_id = tree.set_index("node").to_dict("index")
        pending = [(0, {})]
        while pending:
            at, tests = pending.pop()
            node = by_id[at]
            if node["left"] < 0:
                leaves.append((node["value"], tests))
                continue
            feature, cut = int(node["feature"]), node["threshold"]
            for child, is_left in ((node["left"], True), (node["right"], False)):
                low, high, share = tests.get(feature, (-math.inf, math.inf, 1.0))
                share *= by_id[child]["cover"] / node["cover"]
                bounds = (low, min(high, cut), share) if is_left else (max(low, cut), high, share)
                pending.append((child, {**tests, feature: bounds}))
    return leaves


def _pattern_values(values: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of leaves with k tests, for every pattern of met tests: [leaf, 2^k, k].

    A test that is unknown counts with its share. The worth of all sets of s other tests is
    the coefficient of z^s in the product of (share + met z), so a sum over sets is one product.
    """
    k = shares.shape[1]
    met = ((np.arange(2**k)[:, None] >> np.arange(k)) & 1).astype(float)
    weight = np.array([math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)])
    out = np.zeros((len(values), 2**k, k))
    for i in range(k):
        worth = np.ones((len(values), 2**k, 1))
        for j in range(k):
            if j != i:
                longer = np.zeros((*worth.shape[:2], worth.shape[2] + 1))
                longer[..., :-1] += worth * shares[:, None, j, None]
                longer[..., 1:] += worth * met[None, :, j, None]
                worth = longer
        out[:, :, i] = values[:, None] * (met[None, :, i] - shares[:, None, i]) * (worth @ weight)
    return out


def _bits(feature: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each tested feature: its cuts, and what each interval between them adds to the patterns of all leaves.

    An interval ends with its cut. The last rows are for values above all cuts, no number, and minus infinity.
    """
    found = {}
    for f in np.unique(feature):
        mine = feature == f
        cuts = np.unique(np.concatenate([low[mine], high[mine]]))
        cuts = cuts[np.isfinite(cuts)]
        seen = np.concatenate([cuts, [np.inf, np.nan, -np.inf]])[:, None, None]
        met = mine & (seen > low) & (seen <= high)
        place = (met * (1 << np.arange(feature.shape[1]))).sum(axis=2)
        found[int(f)] = (cuts, place.astype(np.uint8 if feature.shape[1] <= 8 else np.int64))
    return found


def _tables(nodes: pd.DataFrame):
    """Leaves grouped by the number of tested features, and the mean score."""
    trees = nodes["tree"].nunique()
    leaves = _leaf_paths(nodes)
    base = sum(v * math.prod(s for _, _, s in tests.values()) for v, tests in leaves) / trees
    grouped: dict[int, list] = {}
    for value, tests in leaves:
        if tests:
            grouped.setdefault(len(tests), []).append((value / trees, tests))
    tables = []
    for k, members in grouped.items():
        feature = np.array([list(t) for _, t in members])
        low, high = (np.array([[b[side] for b in t.values()] for _, t in members]) for side in (0, 1))
        tables.append({
            "feature": feature, "bits": _bits(feature, low, high),
            "values": _pattern_values(
                np.array([v for v, _ in members]), np.array([[b[2] for b in t.values()] for _, t in members])
            ),
        })
    return tables, base


def _attribute(x: np.ndarray, tables, rows: int = 128) -> np.ndarray:
    """Attributions of each row and feature, ``rows`` rows at a time."""
    out = np.zeros(x.shape)
    for table in tables:
        feature, values = table["feature"], table["values"]
        leaves, k = feature.shape
        patterns = values.shape[1]
        flat = values.reshape(leaves * patterns, k)
        first = np.arange(leaves) * patterns
        into = np.zeros((leaves * k, x.shape[1]))
        into[np.arange(leaves * k), feature.ravel()] = 1.0
        found = []
        for f, (cuts, bits) in table["bits"].items():
            v = x[:, f]
            interval = np.searchsorted(cuts, v)
            interval[np.isnan(v)] = len(cuts) + 1
            interval[v == -np.inf] = len(cuts) + 2
            found.append((interval, bits))
        for begin in range(0, len(x), rows):
            pattern = sum(bits[interval[begin:begin + rows]] for interval, bits in found)
            picked = flat.take(first + pattern, axis=0)
            out[begin:begin + rows] += picked.reshape(len(pattern), leaves * k) @ into
    return out


def with_attributions(table: DataFrame, model: PipelineModel, base: str = "base_score") -> DataFrame:
    """Replace each feature by its attribution; they and the base add up to the score."""
    features = features_of(model)
    nodes = forest_nodes(table, model).toPandas()  # bounded by trees and depth
    tables, mean = _tables(nodes)
    shared = table.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("array<double>")
    def attribute(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(list(_attribute(x, shared.value)), dtype=object)

    values = attribute(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return (
        table.withColumn("__a", values)
        .withColumns({f: F.col("__a")[i] for i, f in enumerate(features)})
        .withColumn(base, F.lit(float(mean))).drop("__a")
    )


def top_features(attributions: DataFrame, features: Sequence[str], k: int = 5) -> DataFrame:
    """The k largest attributions of each row by size, with direction; no shuffle."""
    entries = F.array(*[
        F.struct(
            (-F.abs(F.col(f))).alias("size"), F.lit(i).alias("place"), F.lit(f).alias("feature"),
            F.col(f).alias("contribution"),
        )
        for i, f in enumerate(features)
    ])
    picked = F.posexplode(F.slice(F.sort_array(entries), 1, k))
    kept = [c for c in attributions.columns if c not in features]
    return attributions.select(*kept, picked.alias("pos", "e")).select(
        *kept, (F.col("pos") + 1).alias("feature_rank"), "e.feature", "e.contribution",
        F.when(F.col("e.contribution") > 0, "up").otherwise("down").alias("direction"),
    )
