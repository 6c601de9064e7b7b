"""Score normalisation, fusion, thresholds and composite ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import (
    DEPLOY_FUSION, DEPLOY_THRESHOLD, DetectorSettings, FALLBACK_THRESHOLD, FusionSettings,
    RANK_WEIGHTS, TRAINING_FUSION,
)
from riskloom.functions.scores import (
    above, anchored_share, both_flagged, clip, inverted_share, range_share,
)
from riskloom.operators.ordering import exact_quantiles


def _bounds(table: DataFrame, *columns: str):
    """Minimum and maximum of each column as one scalar value."""
    return table.agg(F.struct(*[
        build(c).alias(f"{c}_{name}") for c in columns
        for name, build in (("min", F.min), ("max", F.max))
    ]).alias("b")).scalar()


def normalised(table: DataFrame, column: str, name: str, invert: bool = True) -> DataFrame:
    """Min-max share of a score over the whole table; 0 everywhere for a constant score."""
    b = _bounds(table, column)
    low, high = b[f"{column}_min"], b[f"{column}_max"]
    if invert:
        share = inverted_share(F.col(column), low, high)
    else:
        share = F.when(high == low, 0.0).otherwise((F.col(column) - low) / (high - low))
    return table.withColumn(name, share)


def fused(table: DataFrame, fusion: FusionSettings = TRAINING_FUSION) -> DataFrame:
    """Normalise both detectors on this table, reward agreement, mix with the forest.

    Expects ``supervised_score, iso_score, lof_score, iso_prediction, lof_prediction``.
    The ``lof`` columns hold the envelope's results; the names are kept for readers of
    the reports.
    """
    b = _bounds(table, "iso_score", "lof_score")
    both = both_flagged(F.col("iso_prediction"), F.col("lof_prediction"))
    mean = (F.col("iso_score_norm") + F.col("lof_score_norm")) / 2
    return (
        table.withColumns({
            "iso_score_norm": inverted_share(F.col("iso_score"), b["iso_score_min"], b["iso_score_max"]),
            "lof_score_norm": inverted_share(F.col("lof_score"), b["lof_score_min"], b["lof_score_max"]),
            "flagged_by_both": both,
        })
        .withColumn("unsupervised_score", clip(
            F.when(F.col("flagged_by_both") == 1, mean * fusion.consensus_bonus).otherwise(mean), 0.0, 1.0
        ))
        .withColumn("combined_risk_score", clip(
            fusion.supervised_weight * F.col("supervised_score")
            + fusion.unsupervised_weight * F.col("unsupervised_score"), 0.0, 1.0
        ))
    )


def fused_for_deployment(
    table: DataFrame, iso_range: tuple[float, float] | None = None,
    threshold: float = DEPLOY_THRESHOLD, fusion: FusionSettings = DEPLOY_FUSION,
) -> DataFrame:
    """Fuse against the training range of the isolation score; no bonus.

    Without a saved range the table's own is used. The envelope score always uses the
    table's own range.
    """
    b = _bounds(table, "iso_score", "lof_score")
    low, high = (F.lit(v) for v in iso_range) if iso_range else (b["iso_score_min"], b["iso_score_max"])
    return (
        table.withColumns({
            "iso_score_norm": anchored_share(F.col("iso_score"), low, high),
            "lof_score_norm": anchored_share(F.col("lof_score"), b["lof_score_min"], b["lof_score_max"]),
            "flagged_by_both": both_flagged(F.col("iso_prediction"), F.col("lof_prediction")),
        })
        .withColumn("unsupervised_score", (F.col("iso_score_norm") + F.col("lof_score_norm")) / 2)
        .withColumn(
            "combined_risk_score",
            fusion.supervised_weight * F.col("supervised_score")
            + fusion.unsupervised_weight * F.col("unsupervised_score"),
        )
        .withColumn("above_threshold", above(F.col("combined_risk_score"), threshold))
    )


def with_composite_rank_score(
    users: DataFrame, weights: tuple[float, float] = RANK_WEIGHTS
) -> DataFrame:
    """Weighted share of the mean risk and of the number of days above the threshold."""
    b = _bounds(users, "final_risk_score", "days_above_threshold")
    parts = [
        weight * range_share(F.col(c), b[f"{c}_min"], b[f"{c}_max"])
        for weight, c in zip(weights, ("final_risk_score", "days_above_threshold"))
    ]
    return users.withColumn("composite_rank_score", parts[0] + parts[1])


# Exported threshold, the score it is taken from, and the percentile.
# Low detector scores are the anomalous ones.
THRESHOLD_QUANTILES = {
    "combined_risk_p99": ("combined_risk_score", 0.99),
    "combined_risk_p98": ("combined_risk_score", 0.98),
    "combined_risk_p95": ("combined_risk_score", 0.95),
    "supervised_p98": ("supervised_score", 0.98),
    "supervised_p95": ("supervised_score", 0.95),
    "iso_score_p98": ("iso_score", 0.02),
    "iso_score_p95": ("iso_score", 0.05),
    "lof_score_p98": ("lof_score", 0.02),
}


def thresholds(
    table: DataFrame, version: str, detector: DetectorSettings = DetectorSettings(),
    approximate: bool = False,
) -> DataFrame:
    """One row of score percentiles, detector ranges and population sizes."""
    columns = sorted({c for c, _ in THRESHOLD_QUANTILES.values()})
    ranges = [
        build(c).alias(f"{c}_{name}") for c in ("iso_score", "lof_score")
        for name, build in (("min", F.min), ("max", F.max))
    ]
    sizes = table.agg(
        *ranges, F.count(F.lit(1)).alias("training_rows"),
        F.count_distinct("user").alias("training_users"),
    )
    if approximate:
        quantiles = table.agg(*[
            F.percentile_approx(c, p, 100_000).alias(n) for n, (c, p) in THRESHOLD_QUANTILES.items()
        ])
    else:
        quantiles = exact_quantiles(table, {c: c for c in columns}, THRESHOLD_QUANTILES)
    q = quantiles.select(F.struct("*").alias("q")).scalar()
    return sizes.select(
        *[q[n].alias(n) for n in THRESHOLD_QUANTILES],
        *[f"{c}_{e}" for c in ("iso_score", "lof_score") for e in ("min", "max")],
        F.lit(detector.contamination).alias("contamination_used"),
        "training_rows", "training_users", F.lit(version).alias("corpus_version"),
        q["combined_risk_p98"].alias("recommended_threshold"),
    )


def recommended_threshold(saved: DataFrame | None, override: float | None = None) -> float:
    """The threshold to apply: the override, else the saved one, else the fallback."""
    if override is not None:
        return override
    if saved is None:
        return FALLBACK_THRESHOLD
    return float(saved.first()["recommended_threshold"])  # one row
