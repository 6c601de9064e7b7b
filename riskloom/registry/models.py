"""Fitted models on the labelled user-days."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskloom.config import DetectorSettings, ForestSettings, MODEL_FEATURES
from riskloom.operators import envelope, explain, supervised
from riskloom.operators.assemble import imputed
from riskloom.operators.detectors import unsupervised
from riskloom.operators.isolation import fit_isolation
from riskloom.operators.labels import insider_users
from riskloom.plans.host import host_report_days
from riskloom.plans.materialise import new_path, stored
from riskloom.plans import runs
from riskloom.plans.training import deploy, train
from riskloom.registry import views
from riskloom.registry.core import query, rounded
from riskloom.registry.features import corpus
from riskloom.registry.labelling import labelled
from riskloom.registry.sql_views import with_steps
from riskloom.sources import stores

FEATURES = list(MODEL_FEATURES)
_DAYS = 'select usr as "user", day'


def _gap(value):
    """A difference as whole millionths, so that rounding noise is nothing."""
    return F.round(value * 1_000_000).cast("long")


def _stored_days(spark, sf):
    return stored(labelled(spark, sf), "labelled", spread=True)


@query()
def forest_scores(spark, sf):
    """Insider probability of every user-day."""
    table = _stored_days(spark, sf)
    scored = supervised.with_forest_score(table, supervised.fit_forest(table, FEATURES))
    return scored.select("user", "day", "insider_label", supervised.SCORE)


@query()
def forest_importances(spark, sf):
    """Ten most important features of the forest."""
    table = _stored_days(spark, sf)
    return supervised.feature_importances(table, supervised.fit_forest(table, FEATURES))


@query()
def holdout_evaluation(spark, sf):
    """Mean AUC and precision over five splits by user."""
    runs = supervised.holdout_runs(_stored_days(spark, sf), FEATURES)
    return supervised.mean_and_spread(runs, ["roc_auc", "precision_at_k"])


@query()
def cross_validation(spark, sf):
    """Mean precision, recall, F1 and AUC over five folds."""
    runs = supervised.cross_validation_runs(_stored_days(spark, sf), FEATURES)
    return supervised.mean_and_spread(runs, ["precision", "recall", "f1", "roc_auc"])


@query()
def isolation_scores(spark, sf):
    """Isolation score and flag of every user-day."""
    _, scored = fit_isolation(_stored_days(spark, sf), FEATURES)
    return scored.select("user", "day", "iso_score", "iso_prediction")


@query(with_steps(" union all ".join(
    f"""select '{c}' as feature, round(avg(coalesce({c}, 0)), 6) as mean,
    round(case when stddev_pop(coalesce({c}, 0)) > 0 then stddev_pop(coalesce({c}, 0)) else 1 end, 6) as scale
    from labelled where insider_label = 0""" for c in FEATURES), "labelled"))
def normal_scaling(spark, sf):
    """Centre and scale of every feature over unlabelled days."""
    return rounded(envelope.scaling(labelled(spark, sf).where(F.col("insider_label") == 0), FEATURES))


@query()
def envelope_scores(spark, sf):
    """Robust distance and flag of every user-day."""
    table = _stored_days(spark, sf)
    model = envelope.fit_envelope(table.where(F.col("insider_label") == 0), FEATURES)
    return model.transform(table).select("user", "day", "lof_score", "lof_prediction")


@query()
def detector_scores(spark, sf):
    """Both detectors on one table."""
    _, _, scored = unsupervised(_stored_days(spark, sf), FEATURES)
    return scored.select("user", "day", "iso_score", "iso_prediction", "lof_score", "lof_prediction")


@query()
def scores_from_saved_forest(spark, sf):
    """A saved forest applied to days that lack a trained column."""
    table = _stored_days(spark, sf)
    path = new_path(spark, "model")
    stores.save_forest(supervised.fit_forest(table, FEATURES), path)
    scored = supervised.score_without_labels(table.drop("usb_count"), stores.load_forest(path))
    return scored.select("user", "day", "insider_label", supervised.SCORE)


@query()
def day_attributions(spark, sf):
    """Contribution of every feature to the forest score of every user-day."""
    table = _stored_days(spark, sf)
    model = supervised.fit_forest(table, FEATURES)
    scored = supervised.with_forest_score(table, model).select("user", "day", supervised.SCORE, *FEATURES)
    return explain.with_attributions(scored, model)


@query()
def training_run(spark, sf):
    """Labels, forest, detectors and fusion: the ranked user report."""
    result = train(corpus(spark, sf), views.incidents(spark, sf), views.VERSION)
    return result.users


def _host_days(spark, sf):
    return host_report_days(
        views.host_events(spark, sf), views.DEVICE_VIEW_PATTERN, views.HOST_VIEW, views.CLEANING_VIEW
    ).withColumn("day", F.col("date")).drop("date")


@query()
def deployment_run(spark, sf):
    """A training run's models applied to the host user-days: the ranked user report."""
    result = train(corpus(spark, sf), views.incidents(spark, sf), views.VERSION)
    limits = result.thresholds.first()  # one row
    days = _host_days(spark, sf)
    _, users, _ = deploy(days, result.models, (limits["iso_score_min"], limits["iso_score_max"]))
    return users


def _saved(spark, sf, evaluated=False):
    """A small training run, written to a folder of its own."""
    small = ForestSettings(trees=20, min_leaf=10)
    result = train(corpus(spark, sf), views.incidents(spark, sf), views.VERSION, small, evaluated=evaluated, seeds=range(2), folds=2)
    return result, runs.save_run(result, new_path(spark, "run"))


@query(with_steps("""select 'days' as name, count(*) as rows, count(*) as rows_now from labelled
    union all select 'users', count(distinct usr), count(distinct usr) from labelled
    union all select 'attributions', sum(least(n, 3))::bigint, sum(least(n, 3))::bigint from (select count(*) as n from labelled group by usr)
    union all select 'explanations', 5 * sum(least(n, 3))::bigint, 5 * sum(least(n, 3))::bigint from (select count(*) as n from labelled group by usr)
    union all select 'thresholds', 1, 1 union all select 'run', 1, 1""", "labelled"))
def saved_run_parts(spark, sf):
    """Tables of a saved run, as its manifest and its folder have them."""
    _, run = _saved(spark, sf)
    return runs.rows_by_part(runs.open_run(spark, run.path, verify=True))


@query(with_steps(f"""select '{views.VERSION}' as version, count(*) as rows, count(distinct usr) as users,
    count(*) filter (insider_label = 1) as insider_days,
    count(distinct case when insider_label = 1 then usr end) as insider_users from labelled""", "labelled"))
def saved_run_summary(spark, sf):
    """The run's own line, read from its folder."""
    _, run = _saved(spark, sf)
    return run.table("run").select("version", "rows", "users", "insider_days", "insider_users")


@query()
def saved_run_explanations(spark, sf):
    """The five largest contributions to each explained day of a saved run, for readers."""
    _, run = _saved(spark, sf)
    return run.table("explanations")


@query(with_steps("""select sum(least(n, 3))::bigint as days, 0::bigint as differing
    from (select count(*) as n from labelled group by usr)""", "labelled"))
def explanations_agree(spark, sf):
    """Explained days, and those whose listed contributions are not the five largest, in order, with their direction."""
    _, run = _saved(spark, sf)
    said = run.table("explanations").groupBy("user", "day").agg(
        F.sort_array(F.collect_list(F.struct("feature_rank", "contribution", "direction"))).alias("said")
    )
    sizes = F.sort_array(F.array(*[F.abs(F.col(c)) for c in FEATURES]), asc=False)
    largest = run.table("attributions").select("user", "day", F.slice(sizes, 1, 5).alias("largest"))
    gap = F.aggregate(
        F.arrays_zip("largest", "said"), F.lit(0.0),
        lambda total, x: total + F.abs(x["largest"] - F.abs(x["said"]["contribution"]))
        + F.when((x["said"]["contribution"] > 0) == (x["said"]["direction"] == "up"), 0.0).otherwise(1.0),
    )
    return largest.join(said, ["user", "day"], "left").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.coalesce(_gap(gap) != 0, F.lit(True))).alias("differing")
    )


@query()
def training_evaluation(spark, sf):
    """Holdout and cross-validation inside a training run."""
    result, _ = _saved(spark, sf, evaluated=True)
    return result.evaluation.metrics


@query(with_steps("select count(distinct usr) as users, 0::bigint as differing from host_clean_days", "host_clean_days"))
def saved_run_deploys_alike(spark, sf):
    """Users whose report differs when the models and limits come from the folder."""
    result, run = _saved(spark, sf)
    days = stored(_host_days(spark, sf), "host-days")
    limits = result.thresholds.first()  # one row
    _, users, _ = deploy(days, result.models, (limits["iso_score_min"], limits["iso_score_max"]))
    _, again, _ = runs.deploy_run(run, days)
    both = users.join(again.select("user", F.col("final_risk_score").alias("again")), "user", "full")
    return both.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.coalesce(_gap(F.col("final_risk_score") - F.col("again")) != 0, F.lit(True))).alias("differing"),
    )


# One tree of one split on 0/1 columns: small enough for SQL to find the same split and the same leaves. Two leaves that
# name the same class are one leaf.
SWITCHES = ["weekend_session_flag", "usb_after_hours_flag", "usb_on_weekend_flag", "job_site_visits_flag", "job_search_plus_usb_week"]
STUMP = ForestSettings(trees=1, depth=1, min_leaf=1, bootstrap=False)
_WEIGHED = """weighed as (select usr, day, insider_label, {columns},
    pow(count(*) over () / (2.0 * count(*) over (partition by insider_label)), 2) as weight from labelled)""".format(
    columns=", ".join(f"coalesce({c}, 0) as {c}" for c in SWITCHES))
_SIDES = " union all ".join(
    f"""select {i} as place, '{c}' as feature, {c} as side, sum(weight) as w,
    coalesce(sum(weight) filter (insider_label = 1), 0) as w1 from weighed group by {c}""" for i, c in enumerate(SWITCHES))
_BEST = f"""{_WEIGHED}, sides as ({_SIDES}), purity as (
    select place, feature, sum(w * (1 - pow(w1 / w, 2) - pow(1 - w1 / w, 2))) as impurity
    from sides group by place, feature having count(*) = 2
), best as (select feature from purity order by round(impurity, 9), place limit 1),
told as (select count(distinct s.w1 / s.w > 0.5) = 2 as apart, sum(s.w1) / sum(s.w) as whole
    from best b join sides s on s.feature = b.feature)"""


def _stump(spark, sf):
    table = _stored_days(spark, sf)
    return table, supervised.fit_forest(table, SWITCHES, STUMP)


@query(with_steps(f"""select * from (with {_BEST}
    select w.usr as "user", w.day, round(case when t.apart then s.w1 / s.w else t.whole end, 6) as supervised_score
    from weighed w, best b, sides s, told t where s.feature = b.feature and s.side = case b.feature {" ".join(f"when '{c}' then w.{c}" for c in SWITCHES)} end)""", "labelled"))
def stump_scores(spark, sf):
    """Insider probability of every user-day from a forest of one split."""
    table, model = _stump(spark, sf)
    return rounded(supervised.with_forest_score(table, model).select("user", "day", supervised.SCORE))


@query(with_steps(f"""select * from (with {_BEST}, names as ({" union all ".join(f"select '{c}' as feature" for c in SWITCHES)})
    select n.feature, case when t.apart and n.feature = b.feature then 1.0::double else 0.0::double end as importance
    from names n, best b, told t)""", "labelled"))
def stump_importances(spark, sf):
    """Importances of a forest of one split: its feature has all."""
    table, model = _stump(spark, sf)
    return supervised.feature_importances(table, model)


# Properties that hold for every row, whatever was drawn: Spark computes them from the
# models' results, the SQL names the rows and the value that each must have.
@query(with_steps(f"{_DAYS}, insider_label, true as bounded from labelled", "labelled"))
def forest_scores_bounded(spark, sf):
    """Every labelled day has a probability."""
    score = F.col(supervised.SCORE)
    bounded = F.coalesce(score.between(0, 1), F.lit(False))
    return forest_scores(spark, sf).select("user", "day", "insider_label", bounded.alias("bounded"))


@query(f"select {len(FEATURES)} as features, cast(1000000 as bigint) as millionths")
def importances_add_up(spark, sf):
    """The importances of all features are shares of one whole."""
    table = _stored_days(spark, sf)
    rows = supervised.feature_importances(table, supervised.fit_forest(table, FEATURES), len(FEATURES))
    return rows.agg(F.count(F.lit(1)).cast("int").alias("features"), _gap(F.sum("importance")).alias("millionths"))


@query(with_steps(f"{_DAYS}, cast(0 as bigint) as gap from labelled", "labelled"))
def attributions_add_up(spark, sf):
    """Attributions and base of every day against its score."""
    whole = sum((F.col(f) for f in FEATURES), F.col("base_score"))
    return day_attributions(spark, sf).select("user", "day", _gap(whole - F.col(supervised.SCORE)).alias("gap"))


@query(with_steps(f"{_DAYS}, cast(0 as bigint) as forest, cast(0 as bigint) as isolation, cast(0 as bigint) as envelope from labelled", "labelled"))
def saved_models_agree(spark, sf):
    """Scores of saved and read models less those of the models themselves."""
    table = _stored_days(spark, sf)
    path = new_path(spark, "models")
    forest = supervised.fit_forest(table, FEATURES)
    trees, shape, _ = unsupervised(table, FEATURES)
    stores.save_forest(forest, f"{path}/forest")
    stores.save_isolation(trees, f"{path}/isolation")
    stores.save_envelope(spark, shape, f"{path}/envelope")
    keys = ["user", "day"]
    kept = imputed(table, FEATURES)

    def scored(forest, trees, shape, mark):
        rows = shape.transform(trees.transform(supervised.with_forest_score(kept, forest)))
        return rows.select(*keys, *[F.col(c).alias(c + mark) for c in (supervised.SCORE, "iso_score", "lof_score")])

    saved = scored(
        stores.load_forest(f"{path}/forest"), stores.load_isolation(spark, f"{path}/isolation"),
        stores.load_envelope(spark, f"{path}/envelope"), "_saved",
    )
    both = scored(forest, trees, shape, "").join(saved, keys)
    names = {supervised.SCORE: "forest", "iso_score": "isolation", "lof_score": "envelope"}
    return both.select(*keys, *[_gap(F.col(c) - F.col(c + "_saved")).alias(n) for c, n in names.items()])


@query(with_steps(f"{_DAYS}, true as isolation, true as envelope from labelled", "labelled"))
def detector_flags_agree(spark, sf):
    """Both detectors flag exactly the days whose score lies below their limit."""
    trees, shape, scored = unsupervised(_stored_days(spark, sf), FEATURES)
    return scored.select(
        "user", "day", ((F.col("iso_prediction") == -1) == (F.col("iso_score") < 0)).alias("isolation"),
        ((F.col("lof_prediction") == -1) == (F.col("lof_score") < shape.offset)).alias("envelope"),
    )


@query("select 'isolation' as detector, true as near_share union all select 'envelope', true")
def detector_shares_agree(spark, sf):
    """The flagged rows of each fit are the contamination share, within one row."""
    _, _, scored = unsupervised(_stored_days(spark, sf), FEATURES)
    normal = F.col("insider_label") == 0
    one = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("iso_prediction") == -1).alias("iso"),
        F.count_if(normal).alias("normal"), F.count_if(normal & (F.col("lof_prediction") == -1)).alias("lof"),
    )
    share = DetectorSettings().contamination
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("detector"), (F.abs(F.col(hits) - share * F.col(rows)) <= 1).alias("near_share"))
        for name, hits, rows in (("isolation", "iso", "n"), ("envelope", "lof", "normal"))
    ])))


def _plain_auc(scored, group):
    """AUC per group by the library's evaluator, one group at a time."""
    spark = scored.sparkSession
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol=supervised.SCORE, labelCol="insider_label", metricName="areaUnderROC", numBins=0
    )
    groups = [r[0] for r in scored.select(group).distinct().collect()]  # seeds or folds
    return spark.createDataFrame(
        [(g, float(evaluator.evaluate(scored.where(F.col(group) == g)))) for g in groups], f"{group} int, plain double"
    )


@query("select cast(unnest(range(5)) as integer) as seed, cast(0 as bigint) as auc_gap, true as bounded")
def holdout_metrics_agree(spark, sf):
    """The metrics of every seed against the library's own on the same scores."""
    table = _stored_days(spark, sf)
    scored = supervised.holdout_scores(table, FEATURES)
    found = supervised.holdout_metrics(scored, insider_users(table))
    return found.join(_plain_auc(scored, "seed"), "seed").select(
        "seed", _gap(F.col("roc_auc") - F.col("plain")).alias("auc_gap"), F.col("precision_at_k").between(0, 1).alias("bounded")
    )


@query("select cast(unnest(range(5)) as integer) as fold, cast(0 as bigint) as auc_gap, cast(0 as bigint) as f1_gap")
def fold_metrics_agree(spark, sf):
    """The metrics of every fold against the library's own and the harmonic mean."""
    scored = supervised.cross_validation_scores(_stored_days(spark, sf), FEATURES)
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    return supervised.cross_validation_metrics(scored).join(_plain_auc(scored, "fold"), "fold").select(
        F.col("fold").cast("int").alias("fold"), _gap(F.col("roc_auc") - F.col("plain")).alias("auc_gap"),
        _gap(F.col("f1") - f1).alias("f1_gap"),
    )
