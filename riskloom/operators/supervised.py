"""Supervised forest: fit, score, and the two evaluation loops."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import ForestSettings, HOLDOUT_FOREST, REPORT_ROWS
from riskloom.operators.assemble import align, imputed
from riskloom.operators.labels import (
    holdout_users, insider_users, stratified_folds, with_class_weights,
)
from riskloom.operators.ordering import exact_quantiles, running_totals
from riskloom.plans.materialise import stored

SCORE = "supervised_score"


def assembler(features: Sequence[str]) -> VectorAssembler:
    """Feature columns as one vector."""
    return VectorAssembler(inputCols=list(features), outputCol="features")


def fitting_rows(
    table: DataFrame, settings: ForestSettings, keys: Sequence[str] = ("user", "day"), share: Column | None = None
) -> DataFrame:
    """Weighted rows that a fit reads: every row, unless ``fit_rows`` bounds the days that are no insider's.

    Class weights come from all rows. Under a bound every insider day stays, and of the other days those with the largest
    priority: a seeded hash in (0, 1] to the power 1 / ``share`` (1 for all rows by default), so a row is drawn in proportion
    to its share; the cut is the exact order statistic, whatever the layout. Their weights grow by what was left out, which
    keeps the balance of the classes. Up to ``fit_rows`` other days nothing changes.
    """
    rows = with_class_weights(table, settings.weight_power)
    k = settings.fit_rows
    if k is None:
        return rows
    insider = F.col("insider_label") == 1
    n = table.agg(F.count_if(~insider)).first()[0]
    if n <= k:
        return rows
    even = (F.pmod(F.xxhash64(*keys, F.lit(settings.seed)), F.lit(1 << 53)) + 1) / float(1 << 53)
    priority = F.when(~insider, even if share is None else F.pow(even, 1 / share))
    # Between the position of the last row left out and that of the first one kept.
    placed = rows.withColumn("__priority", priority)
    cut = exact_quantiles(placed, {"p": "__priority"}, {"cut": ("p", (n - k - 0.5) / (n - 1))}).first()["cut"]
    return (
        placed.where(insider | (F.col("__priority") > cut))
        .withColumn("weight", F.when(insider, F.col("weight")).otherwise(F.col("weight") * (n / k))).drop("__priority")
    )


def fit_forest(
    table: DataFrame, features: Sequence[str], settings: ForestSettings = ForestSettings(), keys: Sequence[str] = ("user", "day")
) -> PipelineModel:
    """Fit on the weighted ``fitting_rows``. The table is read several times: store it first."""
    forest = RandomForestClassifier(
        labelCol="insider_label", featuresCol="features", weightCol="weight",
        numTrees=settings.trees, maxDepth=settings.depth, minInstancesPerNode=settings.min_leaf,
        featureSubsetStrategy=settings.feature_subset, seed=settings.seed, bootstrap=settings.bootstrap,
    )
    rows = imputed(fitting_rows(table, settings, keys), features)
    vectors = assembler(features).transform(rows).select("features", "insider_label", "weight")
    # A copy leaves the training summary behind: its table would go along with every task, with a session that need not serialize.
    return PipelineModel([assembler(features), forest.fit(vectors).copy()])


def forest_of(model: PipelineModel) -> RandomForestClassificationModel:
    """The forest stage."""
    return model.stages[-1]


def features_of(model: PipelineModel) -> list[str]:
    """The columns the model was trained on, in order."""
    return model.stages[0].getInputCols()


def with_forest_score(table: DataFrame, model: PipelineModel) -> DataFrame:
    """Add the probability of the insider class."""
    scored = model.transform(imputed(table, features_of(model)))
    return scored.withColumn(SCORE, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def score_without_labels(
    table: DataFrame, model: PipelineModel, keys: Sequence[str] = ("user", "day")
) -> DataFrame:
    """Score a table that may lack trained columns; labels are 0."""
    aligned = align(table, features_of(model), keys).withColumn("insider_label", F.lit(0))
    return with_forest_score(aligned, model)


def feature_importances(table: DataFrame, model: PipelineModel, n: int = 10) -> DataFrame:
    """The n most important features (a row per feature, bounded by the model)."""
    rows = [
        (name, float(value))
        for name, value in zip(features_of(model), forest_of(model).featureImportances.toArray())
    ]
    return (
        table.sparkSession.createDataFrame(rows, "feature string, importance double")
        .orderBy(F.col("importance").desc(), "feature").limit(n)
    )


def roc_auc(
    scored: DataFrame, score: str = SCORE, label: str = "insider_label", groups: Sequence[str] = ()
) -> DataFrame:
    """Exact area under the curve per group; ties count half, one class only gives 0.5.

    Rows are first merged by score, so ties cost nothing, and the number of negatives
    below each score is a running total.
    """
    counts = scored.groupBy(*groups, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    placed = running_totals(counts, [F.col(score)], {"neg_upto": "neg"}, groups)
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return placed.groupBy(*groups).agg(
        F.when(pairs > 0, wins / pairs).otherwise(F.lit(0.5)).alias("roc_auc")
    )


def precision_at(
    scored: DataFrame, insiders: DataFrame, k: int = REPORT_ROWS, score: str = SCORE,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Share of insiders among the k users with the highest score; k stays the divisor.

    ``insiders`` holds (user, is_insider).
    """
    users = scored.groupBy(*groups, "user").agg(F.max(score).alias("__best"))
    if groups:
        order = Window.partitionBy(*groups).orderBy(F.col("__best").desc(), "user")
        top = users.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    else:
        top = users.orderBy(F.col("__best").desc(), "user").limit(k)
    hits = F.count_if(F.col("is_insider") == 1)
    return top.join(insiders, "user", "left").groupBy(*groups).agg((hits / k).alias("precision_at_k"))


def threshold_metrics(
    scored: DataFrame, cut: float = 0.5, score: str = SCORE, groups: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall and F1 of the rule ``score > cut``; 0 where undefined."""
    hit, real = F.col(score) > cut, F.col("insider_label") == 1
    tp, fp, fn = (F.count_if(c) for c in (hit & real, hit & ~real, ~hit & real))

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    return scored.groupBy(*groups).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).select(
        *groups,
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def mean_and_spread(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per metric: mean and population deviation over the runs."""
    one = table.agg(*[
        F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"),
                 F.count(m).alias("runs")).alias(m)
        for m in metrics
    ])
    return one.select(F.inline(F.array(*metrics)))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def holdout_scores(
    table: DataFrame, features: Sequence[str], seeds: Sequence[int] = range(5),
    settings: ForestSettings = HOLDOUT_FOREST,
) -> DataFrame:
    """Scores (seed, user, insider_label, score) of the days of users never seen in training.

    A seed whose training or test side has no positive day is left out.
    """
    users = insider_users(table)
    sides = users.select("user")
    for seed in seeds:
        split = holdout_users(users, seed).select("user", F.col("is_test").alias(f"__test_{seed}"))
        sides = sides.join(split, "user", "left")
    # One table holds every split.
    rows = stored(table.join(sides, "user"), "holdout", spread=True)
    real = F.col("insider_label") == 1
    counts = rows.agg(*[
        F.count_if(real & (F.col(f"__test_{seed}") == side)).alias(f"n_{seed}_{side}") for seed in seeds for side in (0, 1)
    ]).first()
    parts = []
    for seed in seeds:
        if not (counts[f"n_{seed}_0"] and counts[f"n_{seed}_1"]):
            continue
        chosen = ForestSettings(**{**settings.__dict__, "seed": seed})
        model = fit_forest(rows.where(F.col(f"__test_{seed}") == 0), features, chosen)
        test = with_forest_score(rows.where(F.col(f"__test_{seed}") == 1), model)
        parts.append(test.select(F.lit(seed).alias("seed"), "user", "insider_label", SCORE))
    if not parts:
        return table.select(F.lit(0).alias("seed"), "user", "insider_label", F.lit(0.0).alias(SCORE)).where("false")
    return stored(_union(parts), "holdout-scores")


def holdout_metrics(scored: DataFrame, users: DataFrame) -> DataFrame:
    """One row per seed: AUC over days and precision over users."""
    return roc_auc(scored, groups=["seed"]).join(precision_at(scored, users, groups=["seed"]), "seed")


def holdout_runs(
    table: DataFrame, features: Sequence[str], seeds: Sequence[int] = range(5),
    settings: ForestSettings = HOLDOUT_FOREST,
) -> DataFrame:
    """One row per seed of ``holdout_scores``: AUC over days and precision over users."""
    return holdout_metrics(holdout_scores(table, features, seeds, settings), insider_users(table))


def cross_validation_scores(
    table: DataFrame, features: Sequence[str], folds: int = 5,
    settings: ForestSettings = ForestSettings(),
) -> DataFrame:
    """Scores (fold, user, insider_label, score) of every day by the model that did not see its fold."""
    keyed = table.withColumn("__key", F.concat_ws("|", "user", F.col("day").cast("string")))
    rows = stored(stratified_folds(keyed, "__key", folds, settings.seed), "folds", spread=True)
    parts = []
    for fold in range(folds):
        model = fit_forest(rows.where(F.col("fold") != fold), features, settings)
        test = with_forest_score(rows.where(F.col("fold") == fold), model)
        parts.append(test.select("fold", "user", "insider_label", SCORE))
    return stored(_union(parts), "fold-scores")


def cross_validation_metrics(scored: DataFrame) -> DataFrame:
    """One row per fold: precision, recall, F1 and AUC on the days left out."""
    return threshold_metrics(scored, groups=["fold"]).join(roc_auc(scored, groups=["fold"]), "fold")


def cross_validation_runs(
    table: DataFrame, features: Sequence[str], folds: int = 5,
    settings: ForestSettings = ForestSettings(),
) -> DataFrame:
    """One row per fold of ``cross_validation_scores``."""
    return cross_validation_metrics(cross_validation_scores(table, features, folds, settings))
