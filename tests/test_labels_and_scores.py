import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from riskloom.operators import labels, quality, reports, scenarios, scoring, supervised

D = date(2024, 1, 1)


def incidents(spark):
    return spark.createDataFrame([
        ("a", "4.2", 1, datetime(2024, 1, 1, 15), datetime(2024, 1, 3, 9)),
        ("a", "4.2", 1, datetime(2024, 1, 3), datetime(2024, 1, 3)),
        ("b", "4.2", 2, datetime(2024, 1, 1), None),
        ("c", "4.2", 2, datetime(2024, 1, 5), datetime(2024, 1, 1)),
        ("d", "5.2", 3, datetime(2024, 1, 1), datetime(2024, 1, 9)),
    ], "user string, dataset string, scenario int, start timestamp, end timestamp")


def test_intervals_become_days(spark):
    got = rows(labels.incident_days(incidents(spark), "4.2"), "user", "day")
    assert got == [("a", D + timedelta(days=i)) for i in range(3)]
    moved = rows(labels.incident_days(incidents(spark), "4.2", -1), "user", "day")
    assert moved == [("a", D + timedelta(days=i - 1)) for i in range(3)]
    assert rows(labels.scenario_counts(incidents(spark), "4.2"), "scenario", "incidents") == [(1, 2), (2, 2)]
    assert labels.distinct_insiders(incidents(spark), "4.2").count() == 3


def user_days(spark, insiders=10, normals=40, days=4):
    data = [
        (f"u{i}", D + timedelta(days=d), int(i < insiders and d == 0), float((i * 7 + d * 3) % 11))
        for i in range(insiders + normals) for d in range(days)
    ]
    return spark.createDataFrame(data, "user string, day date, insider_label int, x double")


def test_split_takes_a_share_of_each_class(spark):
    users = labels.insider_users(user_days(spark))
    split = labels.holdout_users(users, 1)
    assert rows(split.groupBy("is_insider", "is_test").count(), "is_insider", "is_test", "count") == [
        (0, 0, 32), (0, 1, 8), (1, 0, 8), (1, 1, 2)]
    few = labels.holdout_users(users.where("is_insider = 1").limit(3), 1)
    assert few.where("is_test = 1").count() == 1
    assert rows(split, "user", "is_test") == rows(labels.holdout_users(users.repartition(3), 1), "user", "is_test")


def test_folds_are_even_per_class(spark):
    table = user_days(spark).withColumn("k", F.concat_ws("|", "user", F.col("day").cast("string")))
    got = rows(labels.stratified_folds(table, "k", 5, 42).groupBy("insider_label", "fold").count(), "insider_label", "count")
    assert got == [(0, 38)] * 5 + [(1, 2)] * 5


def test_weights_balance_the_classes(spark):
    table = user_days(spark)
    sums = rows(labels.with_class_weights(table, 1).groupBy("insider_label").agg(F.round(F.sum("weight"), 6).alias("w")), "w")
    assert sums == [(100.0,), (100.0,)]


def scored(spark):
    rng = random.Random(4)
    data = [
        (f"u{i % 9}", D + timedelta(days=i // 9), -rng.random(), -rng.random() * 50, rng.random(),
         rng.choice([-1, 1]), rng.choice([-1, 1]), i % 2, int(rng.random() < 0.3), rng.random() - 0.5, int(i % 11 == 0))
        for i in range(180)
    ]
    return spark.createDataFrame(
        data, "user string, day date, iso_score double, lof_score double, supervised_score double, iso_prediction int,"
        " lof_prediction int, is_synthetic int, job_site_visits_flag int, usb_count_zscore double, insider_label int")


def test_training_fusion(spark):
    frame = scored(spark).toPandas()
    norm = lambda s: 1 - (s - s.min()) / (s.max() - s.min())
    unsup = (norm(frame.iso_score) + norm(frame.lof_score)) / 2
    unsup = np.clip(np.where((frame.iso_prediction == -1) & (frame.lof_prediction == -1), unsup * 1.15, unsup), 0, 1)
    expected = np.clip(0.7 * frame.supervised_score + 0.3 * unsup, 0, 1)
    got = scoring.fused(scored(spark)).toPandas()
    assert np.allclose(np.sort(got.combined_risk_score), np.sort(expected))


def test_constant_scores_are_not_anomalous(spark):
    table = scored(spark).withColumn("iso_score", F.lit(-0.5))
    assert {r[0] for r in scoring.fused(table).select("iso_score_norm").collect()} == {0.0}
    anchored = scoring.fused_for_deployment(table, (-0.5, -0.5)).select("iso_score_norm").collect()
    assert {r[0] for r in anchored} == {1.0}


def test_thresholds_match_numpy(spark):
    table = scoring.fused(scored(spark))
    frame, got = table.toPandas(), scoring.thresholds(table, "4.2").first()
    for name, (column, p) in scoring.THRESHOLD_QUANTILES.items():
        assert got[name] == pytest.approx(np.quantile(frame[column], p))
    assert (got["training_rows"], got["training_users"]) == (180, 9)
    near = scoring.thresholds(table, "4.2", approximate=True).first()
    assert near["combined_risk_p95"] == pytest.approx(got["combined_risk_p95"], abs=0.05)
    assert scoring.recommended_threshold(None) == 0.5
    assert scoring.recommended_threshold(None, 0.3793) == 0.3793


def test_peak_is_the_earliest_day_on_ties(spark):
    table = spark.createDataFrame([("a", D + timedelta(days=1), 0.9), ("a", D, 0.9), ("a", D + timedelta(days=2), 0.1)],
                                  "user string, day date, combined_risk_score double")
    assert rows(reports.peak_days(table), "peak_date") == [(D,)]


def test_reports_rank_every_user_once(spark):
    training = reports.training_report(scoring.fused(scored(spark)))
    got = training.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 10))
    risks = [r["final_risk_score"] for r in got]
    assert risks == sorted(risks, reverse=True)
    deployed = scoring.fused_for_deployment(scored(spark), None, 0.5)
    users = reports.deployment_report(deployed).collect()
    assert len(users) == 18
    best = deployed.groupBy("user").agg(reports.peak_day().alias("p")).collect()
    assert {r["user"]: r["p"] for r in best} == {r["user"]: r["peak_date"] for r in users}


def test_breaches_keep_the_latest_days(spark):
    table = spark.createDataFrame([("a", D + timedelta(days=i), int(i != 3)) for i in range(6)] + [("b", D, 0)],
                                  "user string, day date, above_threshold int")
    got = {r["user"]: r for r in reports.breach_summary(table).collect()}
    assert got["a"]["breaches"] == 5 and got["a"]["last_breaches"] == "2024-01-03,2024-01-05,2024-01-06"
    assert got["b"]["breaches"] == 0 and got["b"]["last_breaches"] is None


def test_auc_equals_pair_counting(spark):
    rng = random.Random(8)
    data = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(200)]
    table = spark.createDataFrame(data, "supervised_score double, insider_label int")
    pos = [s for s, y in data if y]
    neg = [s for s, y in data if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert supervised.roc_auc(table).first()[0] == pytest.approx(wins)
    assert supervised.roc_auc(table.where("insider_label = 0")).first()[0] == 0.5


def test_precision_divides_by_k(spark):
    table = spark.createDataFrame([("a", 0.9, 1), ("a", 0.1, 0), ("b", 0.5, 0)], "user string, supervised_score double, insider_label int")
    users = labels.insider_users(table)
    assert supervised.precision_at(table, users, 20).first()[0] == 1 / 20


def test_a_day_can_fit_two_scenarios(spark):
    table = spark.createDataFrame([(3, 3, 1, 0, 0, 3.0), (1, 5, 0, 1, 1, 1.0)],
                                  "after_hours_session_count int, usb_count int, usb_after_hours_flag int,"
                                  " job_site_visits_flag int, job_search_plus_usb_week int, usb_count_zscore double")
    assert [r["scenarios"] for r in scenarios.with_scenarios(table).collect()] == [[1, 3], [2]]
    assert [r["scenarios"] for r in scenarios.with_scenarios(table, True).collect()] == [[1, 3], []]


def test_quality_statuses(spark):
    table = spark.createDataFrame(
        [("a", D, 0.0, 2, 0), ("a", D + timedelta(days=5), 0.0, 1, 0), ("b", D, None, 0, 0)],
        "user string, day date, z_zscore double, flag int, empty int")
    status = {(r["check"], r["column"], r["metric"]): r["status"] for r in quality.quality_report(
        table, {"zscores": ["z_zscore"], "flags": ["flag", "empty"], "required": ["flag", "gone"], "padding": ["z_zscore", "empty"]}
    ).collect()}
    assert status["columns", "gone", "filled_rows"] == "FAIL"
    assert status["flag", "flag", "outside_domain"] == "FAIL"
    assert status["flag", "empty", "rate_percent"] == "WARN"
    assert status["shape", "user", "rows_per_user_min"] == "WARN"
    assert status["zscore", "z_zscore", "zero_percent"] == "WARN"
    assert status["constant", "empty", "top_value_percent"] == "WARN"
    assert status["padding", "", "all_zero_percent"] == "WARN"
    recency = table.select(F.lit(-1).alias("days"))
    assert "FAIL" in {r["status"] for r in quality.check_recency(recency, "days").collect()}


def test_observed_checks_equal_those_of_their_own_pass(spark):
    rows = [("a", at(0).date(), 1, 0.0, 3), ("a", None, 0, -1.0, 0), ("b", at(9e5).date(), 2, None, 0), ("b", at(5e5).date(), None, 0.0, 0)]
    table = spark.createDataFrame(rows, "user string, day date, flag int, since double, n int").repartition(3)
    parts = [
        quality._columns_parts(table, ["flag", "missing"]), quality._dates_parts(F.col("day"), (5, 6), 0.05),
        quality._flags_parts(["flag"]), quality._recency_parts("since"), quality._padding_parts(["since", "n"]),
    ]
    written, said = quality.written_with_checks(table, parts, "observed")
    alone = [
        quality.check_columns(table, ["flag", "missing"]), quality.check_dates(table, F.col("day")), quality.check_flags(table, ["flag"]),
        quality.check_recency(table, "since"), quality.check_padding(table, ["since", "n"]),
    ]
    want = [r for part in alone for r in part.collect()]
    assert sorted(map(str, said.collect())) == sorted(map(str, want)) and len(want) == 2 + 9 + 2 + 2 + 1
    assert written.count() == 4
    _, empty = quality.written_with_checks(table.where("false"), parts, "observed")
    assert len(empty.collect()) == len(want)
