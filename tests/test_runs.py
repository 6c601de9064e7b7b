import glob
import os
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.config import DetectorSettings, ForestSettings, MODEL_FEATURES
from riskloom.plans import runs
from riskloom.plans.training import deploy, run_line, train

FEATURES = list(MODEL_FEATURES)
SMALL = ForestSettings(trees=6, depth=3, min_leaf=2)
FEW = DetectorSettings(isolation_trees=10, isolation_sample=64)


@pytest.fixture(scope="module")
def result(spark):
    rng = np.random.default_rng(1)
    start = date(2024, 1, 1)
    days = [
        (f"u{u}", start + timedelta(days=d), *[float(v) for v in rng.normal(size=len(FEATURES)) + (4 if u < 4 and d < 6 else 0)])
        for u in range(24) for d in range(20)
    ]
    table = spark.createDataFrame(days, "user string, day date, " + ", ".join(f"{f} double" for f in FEATURES))
    incidents = spark.createDataFrame(
        [(f"u{u}", "9", "2024-01-01", "2024-01-06", 1) for u in range(4)], "user string, dataset string, start string, end string, scenario int"
    )
    return train(table, incidents, "9", SMALL, FEW, evaluated=True, seeds=range(2), folds=2)


@pytest.fixture()
def saved(spark, result, tmp_path):
    return runs.save_run(result, str(tmp_path / "run"))


def test_a_run_comes_back_whole(spark, result, saved):
    again = runs.open_run(spark, saved.path, verify=True)
    for name, table in result.tables().items():
        stored = again.table(name)
        assert stored.columns == table.columns and stored.dtypes == table.dtypes
        assert runs.fingerprint(stored) == runs.fingerprint(table)
    counts = {r["name"]: (r["rows"], r["rows_now"]) for r in runs.rows_by_part(again).collect()}
    assert counts["days"] == (480, 480) and counts["explanations"] == (5 * 72, 5 * 72) and counts["run"] == (1, 1)


def test_the_evaluation_and_the_summary_are_part_of_the_run(spark, result, saved):
    metrics = {(r["run"], r["metric"]): r for r in saved.table("metrics").collect()}
    assert set(metrics) == {("holdout", "roc_auc"), ("holdout", "precision_at_k"), *[("folds", m) for m in ("precision", "recall", "f1", "roc_auc")]}
    assert all(r["runs"] == 2 for r in metrics.values()) and metrics["folds", "roc_auc"]["mean"] > 0.9
    line = saved.table("run").first()
    assert (line["version"], line["rows"], line["users"], line["insider_days"], line["insider_users"]) == ("9", 480, 24, 24, 4)
    assert line["fold_auc"] == metrics["folds", "roc_auc"]["mean"] and line["holdout_auc"] == metrics["holdout", "roc_auc"]["mean"]
    shares = [r["importance"] for r in saved.table("importances").collect()]
    assert len(shares) == len(FEATURES) and sum(shares) == pytest.approx(1.0)
    result.evaluation, kept = None, result.evaluation
    assert run_line(result).first()["fold_auc"] is None and "metrics" not in result.tables()
    result.evaluation = kept


def test_explanations_are_the_largest_attributions(result):
    said = {}
    for r in result.explanations.collect():
        said.setdefault((r["user"], r["day"]), []).append(r)
    for r in result.attributions.collect():
        sizes = sorted((abs(r[f]) for f in FEATURES), reverse=True)[:5]
        found = sorted(said[r["user"], r["day"]], key=lambda x: x["feature_rank"])
        assert [abs(x["contribution"]) for x in found] == sizes
        assert all(r[x["feature"]] == x["contribution"] and (x["direction"] == "up") == (x["contribution"] > 0) for x in found)


def test_deployment_starts_from_the_folder(spark, result, saved):
    days = result.days.select("user", "day", *FEATURES[1:])  # a column of the model is missing
    limits = result.thresholds.first()
    _, users, why = deploy(days, result.models, (limits["iso_score_min"], limits["iso_score_max"]), 0.4)
    _, again, why_again = runs.deploy_run(runs.open_run(spark, saved.path), days, 0.4)
    assert sorted(map(str, users.collect())) == sorted(map(str, again.collect()))
    assert why.count() == why_again.count() == 480
    scored, _, _ = runs.deploy_run(saved, days, override=True)
    flags = scored.agg(F.sum("above_threshold"), F.count_if(F.col("combined_risk_score") >= limits["recommended_threshold"])).first()
    assert abs(flags[0] - flags[1]) <= 1


def test_half_written_changed_and_repeated_runs_are_refused(spark, result, saved, tmp_path):
    with pytest.raises(runs.RunError, match="no finished run"):
        runs.open_run(spark, str(tmp_path / "nothing"))
    half = str(tmp_path / "half")
    result.days.write.parquet(f"{half}/tables/days")
    with pytest.raises(runs.RunError, match="no finished run"):
        runs.open_run(spark, half)
    with pytest.raises(runs.RunError, match="holds a run already"):
        runs.save_run(result, saved.path)
    with pytest.raises(runs.RunError, match="no table"):
        saved.table("nothing")
    part = next(f for f in glob.glob(f"{saved.path}/tables/users/part-*.parquet") if os.path.getsize(f))
    result.users.withColumn("rank", F.col("rank") + 1).coalesce(1).write.parquet(str(tmp_path / "other"))
    other = glob.glob(str(tmp_path / "other" / "part-*.parquet"))[0]
    with open(other, "rb") as new, open(part, "wb") as old:
        old.write(new.read())
    for checksum in glob.glob(f"{saved.path}/tables/users/.part-*.crc"):
        os.unlink(checksum)
    with pytest.raises(runs.RunError):
        runs.open_run(spark, saved.path, verify=True)


def test_fingerprints_tell_contents_not_layout(spark):
    table = spark.range(100).select("id", (F.col("id") * 0.1).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    assert runs.fingerprint(table) == runs.fingerprint(table.repartition(7).orderBy(F.rand(1)))
    assert runs.fingerprint(table) != runs.fingerprint(table.withColumn("x", F.when(F.col("id") == 50, 0.0).otherwise(F.col("x"))))
    assert runs.fingerprint(table.limit(0)) == (0, "0" * 16)
