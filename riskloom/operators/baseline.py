"""Per-user baselines, z-scores and population profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scores import clip
from riskloom.operators.ordering import exact_quantiles


def user_stats(daily: DataFrame, value: str) -> DataFrame:
    """Mean, sample deviation and count of a value per user."""
    return daily.groupBy("user").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")
    )


def _scored(value: Column, mean: Column, std: Column, count: Column, minimum: int):
    trusted = F.coalesce((std > 0) & (count >= minimum), F.lit(False))
    return F.when(trusted, (value - mean) / std), trusted.cast("int")


def with_zscore(
    daily: DataFrame, value: str, name: str, minimum_days: int, present: Column | None = None
) -> DataFrame:
    """Add a z-score against the user's whole history and a flag for a usable baseline.

    The score is null without at least ``minimum_days`` days that vary. ``present``
    marks days that have the source; elsewhere the flag is null too. A user has at
    most one row per calendar day, so the window stays small.
    """
    user = Window.partitionBy("user")
    score, trusted = _scored(
        F.col(value), F.avg(value).over(user), F.stddev_samp(value).over(user),
        F.count(value).over(user), minimum_days,
    )
    present = F.col(value).isNotNull() if present is None else present
    return daily.withColumns({name: score, f"{name}_has_baseline": F.when(present, trusted)})


def with_saved_zscore(
    daily: DataFrame, stats: DataFrame, value: str, name: str, minimum_days: int
) -> DataFrame:
    """The same score against per-user statistics read from a saved table."""
    score, trusted = _scored(
        F.col(value), F.col("mean"), F.col("std"), F.col("count"), minimum_days
    )
    return (
        daily.join(stats, "user", "left")
        .withColumns({name: score, f"{name}_has_baseline": trusted})
        .drop("mean", "std", "count")
    )


def population_baseline(daily: DataFrame, value: str) -> DataFrame:
    """One row: mean and deviation of user means, median of user deviations."""
    stats = user_stats(daily, value)
    middle = exact_quantiles(stats, {"std": "std"}, {"typical_user_std": ("std", 0.5)})
    return stats.agg(
        F.avg("mean").alias("population_mean"), F.stddev_samp("mean").alias("population_std")
    ).withColumn("typical_user_std", middle.scalar()).select(
        F.lit(value).alias("metric"), "population_mean", "population_std", "typical_user_std"
    )


def population_zscore(
    daily: DataFrame, baseline: DataFrame, value: str, name: str, low: float = -1.5, high: float = 1.5
) -> DataFrame:
    """Score counts against the population, for users without a baseline of their own."""
    centre = baseline.select("population_mean").scalar()
    spread = baseline.select("typical_user_std").scalar()
    score = F.when(spread > 0, (F.col(value) - centre) / spread)
    return daily.withColumn(name, clip(score, low, high))


# Profile of a feature the table does not have.
MISSING_PROFILE = {"mean": 0.0, "std": 0.1, "min": 0.0, "max": 1.0}


def feature_profile(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of each feature over normal rows."""
    if "insider_label" in table.columns:
        table = table.where(F.col("insider_label") == 0)
    builds: Mapping = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}

    def cell(feature: str, name: str, build) -> Column:
        if feature not in table.columns:
            return F.lit(MISSING_PROFILE[name]).alias(name)
        return build(F.col(feature).cast("double")).alias(name)

    one_row = table.agg(*[
        F.struct(*[cell(f, n, b) for n, b in builds.items()]).alias(f) for f in features
    ] + [F.count(F.lit(1)).alias("__rows")])
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}.mean"), F.col(f"{f}.std"),
                 F.col(f"{f}.min"), F.col(f"{f}.max"))
        for f in features
    ])
    return one_row.select(F.inline(entries))
