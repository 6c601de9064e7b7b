"""Robust-covariance envelope: concentration steps as Spark aggregates.

A step adds up counts, sums and products of the d features by classes of distance: tasks
reduce their Arrow batches to those sums, Spark adds them up, and the driver inverts one d x d
matrix per start. All rows take part at every size, and their layout does not matter.
Rows are never collected. Scoring is one Arrow function of the features, as a column expression of
d * d / 2 terms makes a generated method too long for the virtual machine to compile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import DetectorSettings
from riskloom.operators.assemble import imputed
from riskloom.operators.ordering import exact_quantiles
from riskloom.plans.materialise import stored

DISTANCE = "__distance"
_TOLERANCE = 1e-10
# Distances are counted and summed in this many classes around the last cut.
_CLASSES = 48
_STEPS = 30
# Tasks that add up the sums of all others.
_MERGERS = 64


@dataclass
class Scaler:
    """Centre and population deviation per feature; a constant feature keeps scale 1."""

    features: list[str]
    mean: list[float]
    scale: list[float]

    def columns(self) -> list[Column]:
        """Standardised features."""
        return [
            (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - m) / s
            for f, m, s in zip(self.features, self.mean, self.scale)
        ]


def scaling(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: mean and scale over the given rows."""
    rows = imputed(table, features)
    one = rows.agg(*[
        F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f)
        for f in features
    ])
    scale = F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
    return one.select(F.inline(F.array(*features))).select("feature", "mean", scale.alias("scale"))


def fit_scaler(table: DataFrame, features: Sequence[str]) -> Scaler:
    """Collect the d rows of ``scaling``."""
    rows = {r["feature"]: r for r in scaling(table, features).collect()}
    return Scaler(list(features), [rows[f]["mean"] for f in features], [rows[f]["scale"] for f in features])


def chi2_quantile(p: float, d: int) -> float:
    """Quantile of the chi-square distribution by bisection on its series."""
    def below(x: float) -> float:
        a, h = d / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= h / n
            total += term
        return total * math.exp(-h + a * math.log(h) - math.lgamma(a))

    low, high = 1e-9, 20.0 * d + 200
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return (low + high) / 2


def moments(
    rows: DataFrame, names: Sequence[str], change: Callable[[np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, population covariance and row count of the columns, after ``change`` if one is given."""
    return _moments(_sums(rows, names, lambda x: np.zeros((len(x), 1), np.int64), 1, change=change)[0, 0], len(names))


def _moments(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, population covariance and count from count, sums and products."""
    count = int(sums[0])
    mean = sums[1:d + 1] / count
    return mean, sums[d + 1:].reshape(d, d) / count - np.outer(mean, mean), count


def _sums(
    rows: DataFrame, names: Sequence[str], classes: Callable[[np.ndarray], np.ndarray], n_ways: int, n_classes: int = 1,
    change: Callable[[np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """Count, sums and products of the columns by class, [way, class, 1 + d + d * d], in one pass.

    ``classes`` gives each row's class for each of ``n_ways`` divisions. A task sends its sums as one row;
    ``_MERGERS`` tasks add these up, so the driver gets that many rows however many tasks there are.
    """
    d = len(names)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((n_ways, n_classes, 1 + d + d * d))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            x = change(x) if change else x
            found = classes(x)
            for way in range(n_ways):
                order = np.argsort(found[:, way], kind="stable")
                ends = np.searchsorted(found[order, way], np.arange(n_classes + 1))
                for c in np.flatnonzero(np.diff(ends)):
                    part = x[order[ends[c]:ends[c + 1]]]
                    sums[way, c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        here = TaskContext.get().partitionId() % _MERGERS
        yield pd.DataFrame({"slot": [here], "sums": [sums.astype("<f8").tobytes()]})

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, "<f8") for v in part["sums"]], axis=0)
        return pd.DataFrame({"sums": [total.tobytes()]})

    added = rows.select(*names).mapInPandas(add_up, "slot int, sums binary").groupBy("slot").applyInPandas(merged, "sums binary").collect()
    out = np.zeros(n_ways * n_classes * (1 + d + d * d))
    for row in added:
        out += np.frombuffer(row["sums"], "<f8")
    return out.reshape(n_ways, n_classes, -1)


def _spectrum(covariance: np.ndarray):
    values, vectors = np.linalg.eigh(covariance)
    keep = values > _TOLERANCE * max(values.max(), _TOLERANCE)
    return values[keep], vectors[:, keep]


def inverse(covariance: np.ndarray) -> np.ndarray:
    """Pseudo-inverse, so constant features do not break the distance."""
    values, vectors = _spectrum(covariance)
    return (vectors / values) @ vectors.T


def log_volume(covariance: np.ndarray) -> tuple[int, float]:
    """Rank and log of the product of the non-zero eigenvalues; smaller is tighter."""
    values, _ = _spectrum(covariance)
    return len(values), float(np.log(values).sum())


def _squared_distance(x: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distance of rows, term by term: the same sum whatever rows come together."""
    centred = [x[:, i] - float(m) for i, m in enumerate(mean)]
    total = np.zeros(len(x))
    with np.errstate(invalid="ignore", over="ignore"):
        for i, row in enumerate(precision):
            total += float(row[i]) * centred[i] * centred[i]
            for j in range(i + 1, len(row)):
                if row[j]:
                    total += 2 * float(row[j]) * centred[i] * centred[j]
    return total


def squared_distance(columns: Sequence[Column], mean: np.ndarray, precision: np.ndarray) -> Column:
    """Squared Mahalanobis distance as one column."""
    @F.pandas_udf("double")
    def distance(*values: pd.Series) -> pd.Series:
        return pd.Series(_squared_distance(np.column_stack([v.to_numpy(dtype=float) for v in values]), mean, precision))

    return distance(*columns)


def _directions(rows: DataFrame, names: Sequence[str], mean: np.ndarray) -> np.ndarray:
    """Covariance of the rows' directions from the mean: far rows count no more than near ones."""
    def unit(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        length = np.zeros(len(x))
        for i in range(centred.shape[1]):
            length += centred[:, i] * centred[:, i]
        length = np.sqrt(length)[:, None]
        return np.divide(centred, length, out=np.zeros_like(centred), where=length > 0)

    return moments(rows, names, unit)[1]


def _concentrate(rows: DataFrame, names: Sequence[str], starts, support: float, steps: int = _STEPS):
    """Repeat "keep the nearest share, refit" for all starts at once until the tightest is found.

    One pass a step: rows are counted and summed by classes of distance around the last cut,
    so the cut that covers the share and the moments of the rows within it come from the same
    sums. The cut is an edge between classes, at every size of the table.
    """
    d = len(names)
    states = [
        {"mean": m, "covariance": c, "cut": chi2_quantile(support, d), "span": 8.0, "volume": None, "open": True}
        for m, c in starts
    ]
    for _ in range(steps):
        going = [s for s in states if s["open"]]
        if not going:
            break
        ways = [
            (s["mean"], inverse(s["covariance"]), s["cut"] * np.geomspace(1 / s["span"], s["span"], _CLASSES)) for s in going
        ]

        def classes(x: np.ndarray, ways=ways) -> np.ndarray:
            return np.column_stack([
                np.searchsorted(edges, (((x - m) @ p) * (x - m)).sum(axis=1)) for m, p, edges in ways
            ])

        sums = _sums(rows, names, classes, len(ways), _CLASSES + 1)
        for state, (_, _, edges), found in zip(going, ways, sums):
            upto = np.cumsum(found, axis=0)
            at = min(int(np.searchsorted(upto[:, 0], support * upto[-1, 0])), _CLASSES - 1)
            if upto[at, 0] == 0:
                at = _CLASSES
            inner = 0 < at < _CLASSES - 1
            state["cut"], state["span"] = edges[min(at, _CLASSES - 1)], 2.0 if inner else 8.0
            state["mean"], state["covariance"], _ = _moments(upto[at], d)
            volume = log_volume(state["covariance"])
            last = state["volume"]
            if inner and last is not None and volume[0] == last[0] and volume[1] >= last[1] - 1e-6:
                state["open"] = False
            state["volume"] = volume
    best = min(states, key=lambda s: s["volume"])
    return best["mean"], best["covariance"]


@dataclass
class EnvelopeModel:
    """Scaler, centre, precision matrix and offset."""

    scaler: Scaler
    mean: np.ndarray
    precision: np.ndarray
    offset: float = 0.0

    def distance(self) -> Column:
        """Squared distance of a row to the centre."""
        return squared_distance(self.scaler.columns(), self.mean, self.precision)

    def transform(self, table: DataFrame) -> DataFrame:
        """Add the negated distance and -1 where it falls below the offset."""
        score = -self.distance()
        return table.withColumn("lof_score", score).withColumn(
            "lof_prediction", F.when(F.col("lof_score") < self.offset, -1).otherwise(1)
        )


def fit_envelope(
    normal: DataFrame, features: Sequence[str], settings: DetectorSettings = DetectorSettings()
) -> EnvelopeModel:
    """Fit on all normal rows: two deterministic starts, concentration, reweighting, offset."""
    scaler = fit_scaler(normal, features)
    names = [f"z{i}" for i in range(len(features))]
    rows = stored(
        normal.select(*[c.alias(n) for c, n in zip(scaler.columns(), names)]), "envelope-rows"
    )
    mean, covariance, _ = moments(rows, names)
    starts = [(mean, covariance), (mean, _directions(rows, names, mean) * len(names))]
    mean, covariance = _concentrate(rows, names, starts, settings.support)

    rank = log_volume(covariance)[0]
    columns = [F.col(n) for n in names]
    placed = rows.withColumn(DISTANCE, squared_distance(columns, mean, inverse(covariance)))
    median = exact_quantiles(placed, {"d": DISTANCE}, {"m": ("d", 0.5)}).first()["m"]
    correction = median / chi2_quantile(0.5, rank)
    near = placed.where(F.col(DISTANCE) < correction * chi2_quantile(0.975, rank))
    mean, covariance, _ = moments(near, names)
    model = EnvelopeModel(scaler, mean, inverse(covariance))
    final = rows.select((-squared_distance(columns, mean, model.precision)).alias("s"))
    model.offset = exact_quantiles(final, {"s": "s"}, {"q": ("s", settings.contamination)}).first()["q"]
    return model
