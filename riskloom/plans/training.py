"""Training and deployment flows over the user-day table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import (
    DEPLOY_THRESHOLD, DetectorSettings, EXPLAINED_DAYS, ForestSettings, HOLDOUT_FOREST, MODEL_FEATURES,
)
from riskloom.operators.detectors import unsupervised
from riskloom.operators.envelope import EnvelopeModel
from riskloom.operators.explain import top_features, with_attributions
from riskloom.operators.isolation import IsolationModel
from riskloom.operators.labels import with_labels
from riskloom.operators.reports import deployment_report, top_days, training_report
from riskloom.operators.scoring import fused, fused_for_deployment, thresholds
from riskloom.operators.supervised import (
    cross_validation_runs, feature_importances, fit_forest, holdout_runs, mean_and_spread, score_without_labels,
    with_forest_score,
)
from riskloom.plans.materialise import stored


@dataclass
class TrainedModels:
    """What deployment needs."""

    forest: PipelineModel
    isolation: IsolationModel
    envelope: EnvelopeModel


@dataclass
class Evaluation:
    """How well the forest does on days and users it has not seen, and what it looks at.

    ``metrics``: run ('holdout' or 'folds'), metric, mean, std, runs. ``importances``: feature, importance.
    """

    metrics: DataFrame
    importances: DataFrame


@dataclass
class TrainingResult:
    """Tables and models of one training run; ``evaluation`` where it was asked for."""

    version: str
    days: DataFrame
    users: DataFrame
    attributions: DataFrame
    explanations: DataFrame
    thresholds: DataFrame
    models: TrainedModels
    evaluation: Evaluation | None = None

    def tables(self) -> dict[str, DataFrame]:
        """The tables by name."""
        found = {
            "days": self.days, "users": self.users, "attributions": self.attributions,
            "explanations": self.explanations, "thresholds": self.thresholds,
        }
        if self.evaluation:
            found |= {"metrics": self.evaluation.metrics, "importances": self.evaluation.importances}
        return found


def evaluate(
    table: DataFrame, features: list[str], model: PipelineModel, forest: ForestSettings = ForestSettings(),
    holdout: ForestSettings = HOLDOUT_FOREST, seeds: Sequence[int] = range(5), folds: int = 5,
) -> Evaluation:
    """Holdout by users, cross-validation by days, and the importances of the fitted forest."""
    apart = mean_and_spread(holdout_runs(table, features, seeds, holdout), ["roc_auc", "precision_at_k"])
    crossed = mean_and_spread(cross_validation_runs(table, features, folds, forest), ["precision", "recall", "f1", "roc_auc"])
    metrics = apart.withColumn("run", F.lit("holdout")).unionByName(crossed.withColumn("run", F.lit("folds")))
    return Evaluation(
        stored(metrics.select("run", "metric", "mean", "std", "runs"), "evaluation"),
        feature_importances(table, model, len(features)),
    )


def train(
    days: DataFrame, incidents: DataFrame, version: str,
    forest: ForestSettings = ForestSettings(), detectors: DetectorSettings = DetectorSettings(),
    label_shift_days: int = 0, evaluated: bool = False, seeds: Sequence[int] = range(5), folds: int = 5,
) -> TrainingResult:
    """Label, fit, score, fuse, explain and report. Tables are written between the fits.

    ``evaluated`` adds the forest's holdout and cross-validation, which fit it anew for each seed and fold.
    """
    features = list(MODEL_FEATURES)
    table = stored(with_labels(days, incidents, version, label_shift_days), "labelled", spread=True)
    supervised = fit_forest(table, features, forest)
    isolation, envelope, scored = unsupervised(with_forest_score(table, supervised), features, detectors)
    result = stored(fused(scored), "scored")
    top = top_days(result, EXPLAINED_DAYS).select(
        "user", "day", "combined_risk_score", "supervised_score", *features
    )
    attributions = stored(with_attributions(top, supervised), "attributions")
    return TrainingResult(
        version, result, training_report(result), attributions, top_features(attributions, features),
        thresholds(result, version, detectors), TrainedModels(supervised, isolation, envelope),
        evaluate(table, features, supervised, forest, seeds=seeds, folds=folds) if evaluated else None,
    )


def run_line(result: TrainingResult) -> DataFrame:
    """One row on a whole run: its rows, labels and flags, its limits, and its evaluation (null where there was none)."""
    flagged = {"iso": "iso_prediction", "lof": "lof_prediction"}
    one = result.days.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("user").alias("users"),
        F.count_if(F.col("insider_label") == 1).alias("insider_days"),
        F.count_distinct(F.when(F.col("insider_label") == 1, F.col("user"))).alias("insider_users"),
        *[F.count_if(F.col(c) == -1).alias(f"flagged_{n}") for n, c in flagged.items()],
        F.count_if(F.col("flagged_by_both") == 1).alias("flagged_both"),
        F.max("combined_risk_score").alias("highest_risk"),
    )
    limits = result.thresholds.select(F.struct("combined_risk_p99", "combined_risk_p98", "recommended_threshold")).scalar()
    wanted = {"holdout_auc": ("holdout", "roc_auc"), "holdout_precision": ("holdout", "precision_at_k"), "fold_f1": ("folds", "f1"), "fold_auc": ("folds", "roc_auc")}
    if result.evaluation:
        found = {(r["run"], r["metric"]): r["mean"] for r in result.evaluation.metrics.collect()}  # six rows
    else:
        found = {}
    return one.withColumn("t", limits).select(
        F.lit(result.version).alias("version"), *one.columns, "t.*",
        *[F.lit(found.get(key)).cast("double").alias(name) for name, key in wanted.items()],
    )


def deploy(
    days: DataFrame, models: TrainedModels, iso_range: tuple[float, float] | None,
    threshold: float = DEPLOY_THRESHOLD,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Score days without labels; returns scored days, user report and attributions.

    ``days`` may carry a cohort flag ``is_synthetic``; without one all users are real.
    """
    cohort = F.col("is_synthetic") if "is_synthetic" in days.columns else F.lit(0)
    days = days.withColumn("is_synthetic", cohort)
    keys = ["user", "day", "is_synthetic"]
    table = stored(score_without_labels(days, models.forest, keys), "aligned", spread=True)
    scored = models.envelope.transform(models.isolation.transform(table))
    result = stored(fused_for_deployment(scored, iso_range, threshold), "deployed")
    features = models.isolation.features
    explained = with_attributions(result.select(*keys, *features), models.forest)
    return result, deployment_report(result), explained
