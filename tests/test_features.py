import random
from datetime import date, timedelta

import pytest
from helpers import START, at, rows
from pyspark.sql import functions as F

from riskloom.config import CORPUS, HOST_DAY_COLUMNS, CalendarSettings, FeatureSettings
from riskloom.functions.calendar import (
    after_hours, from_unix_micros, from_webkit_micros, lenient_day, lenient_timestamp, matches, weekend,
)
from riskloom.functions.scores import clip, inverted_share, risk_tier, to_double, to_int, to_strict_int
from riskloom.operators import assemble, baseline
from riskloom.plans.corpus import corpus_days
from riskloom.plans.host import host_days

DAY = START.date()


def daily(spark, values):
    data = [(u, DAY + timedelta(days=d), v) for u, d, v in values]
    return spark.createDataFrame(data, "user string, day date, n long")


def test_calendar_expressions(spark):
    table = spark.createDataFrame(
        [(at(6.99 * 3600),), (at(7 * 3600),), (at(19 * 3600),), (None,), (at(4 * 86400 + 43200),)], "ts timestamp"
    )
    calendar = CalendarSettings()
    got = table.select(after_hours(F.col("ts"), calendar).alias("a"), weekend(F.col("ts"), (4, 5)).alias("w")).collect()
    assert [tuple(r) for r in got] == [(1, 0), (0, 0), (1, 0), (0, 0), (0, 1)]


def test_lenient_parsing(spark):
    table = spark.createDataFrame([("01/02/2024 03:04:05",), ("junk",), (None,)], "s string")
    got = [r[0] for r in table.select(lenient_timestamp(F.col("s"), "MM/dd/yyyy HH:mm:ss")).collect()]
    assert str(got[0]) == "2024-01-02 03:04:05" and got[1:] == [None, None]
    days = spark.createDataFrame([("13/40/2024",), ("12/31/2023",)], "s string").select(lenient_day(F.col("s")))
    assert [r[0] for r in days.collect()] == [None, date(2023, 12, 31)]


def test_browser_clocks(spark):
    table = spark.createDataFrame([(11_644_473_600_000_000 + 1_000_000, 1_000_000), (0, 0), (None, None)], "w long, u long")
    got = table.select(F.unix_micros(from_webkit_micros(F.col("w"))), F.unix_micros(from_unix_micros(F.col("u")))).collect()
    assert [tuple(r) for r in got] == [(1_000_000, 1_000_000), (None, None), (None, None)]


def test_keyword_and_coercion(spark):
    table = spark.createDataFrame([("My LinkedIn",), ("news",), (None,)], "s string")
    assert [r[0] for r in table.select(matches(F.col("s"), "indeed|linkedin")).collect()] == [1, 0, 0]
    text = spark.createDataFrame([("3.9",), ("x",), (None,), ("7",), ("NaN",)], "s string")
    assert [r[0] for r in text.select(to_int(F.col("s"))).collect()] == [3, 0, 0, 7, 0]
    assert [r[0] for r in text.select(to_strict_int(F.col("s"))).collect()] == [0, 0, 0, 7, 0]
    assert [r[0] for r in text.select(to_double(F.col("s"))).collect()][:4] == [3.9, 0.0, 0.0, 7.0]


def test_shares_and_tiers(spark):
    table = spark.createDataFrame([(0.2,), (0.4,), (0.75,), (None,)], "x double")
    assert [r[0] for r in table.select(risk_tier(F.col("x"))).collect()] == ["medium", "high", "critical", "medium"]
    assert [r[0] for r in table.select(inverted_share(F.col("x"), F.lit(1.0), F.lit(1.0))).collect()] == [0.0] * 4
    assert [r[0] for r in table.select(clip(F.col("x"), 0.3, 0.5)).collect()] == [0.3, 0.4, 0.5, None]


def test_zscore_needs_history_that_varies(spark):
    values = [("one", 0, 3)] + [("flat", d, 2) for d in range(6)] + [("four", d, d) for d in range(4)]
    values += [("five", d, d) for d in range(5)]
    got = baseline.with_zscore(daily(spark, values), "n", "z", 5).collect()
    for r in got:
        if r["user"] == "five":
            assert r["z"] == pytest.approx((r["n"] - 2) / 2.5 ** 0.5) and r["z_has_baseline"] == 1
        else:
            assert r["z"] is None and r["z_has_baseline"] == 0


def test_saved_statistics_give_the_same_scores(spark):
    rng = random.Random(2)
    table = daily(spark, [(u, d, rng.randrange(9)) for u in "abc" for d in range(12)])
    direct = rows(baseline.with_zscore(table, "n", "z", 5).withColumn("z", F.round("z", 9)), "user", "day", "z")
    saved = baseline.with_saved_zscore(table, baseline.user_stats(table, "n"), "n", "z", 5)
    assert rows(saved.withColumn("z", F.round("z", 9)), "user", "day", "z") == direct


def test_weekly_signal_reaches_seven_days(spark):
    data = [("in", 0, 1, 0.0), ("in", 6, 0, 2.0), ("out", 0, 1, 0.0), ("out", 7, 0, 2.0), ("null", 0, 1, None)]
    table = spark.createDataFrame(
        [(u, DAY + timedelta(days=d), j, z) for u, d, j, z in data],
        "user string, day date, job_site_visits_flag int, z double",
    )
    got = assemble.with_weekly_compound(table, usb="z")
    flagged = {(r["user"], (r["day"] - DAY).days) for r in got.collect() if r["job_search_plus_usb_week"]}
    assert flagged == {("in", 6)}


def test_fill_keeps_zscores_and_their_flags(spark):
    table = spark.createDataFrame([(None, None, None, None)], "a long, a_zscore double, a_zscore_has_baseline int, m double")
    got = assemble.fill_numeric(table, keep_null=["m"]).first()
    assert tuple(got) == (0, None, None, None)


def logs(spark):
    logon = spark.createDataFrame(
        [(1, "a", at(86400 + 8 * 3600), "Logon"), (2, "a", at(86400 + 9 * 3600), "Logoff")],
        "id long, user string, ts timestamp, activity string")
    device = spark.createDataFrame(
        [(1, "a", at(86400 + 20 * 3600), "pc1", "Connect"), (2, "a", at(5 * 86400), "pc2", "Connect"),
         (3, "a", at(5 * 86400), "pc3", "Disconnect"), (4, "b", at(86400), "pc1", "Connect")],
        "id long, user string, ts timestamp, pc string, activity string")
    web = spark.createDataFrame([(1, "a", at(3 * 86400), "https://indeed.com")], "id long, user string, ts timestamp, url string")
    return logon, device, web


def test_user_days_are_the_outer_union_of_sources(spark):
    got = {(r["user"], str(r["day"])): r for r in corpus_days(*logs(spark), CORPUS).collect()}
    assert set(got) == {("a", "2024-01-01"), ("a", "2024-01-05"), ("a", "2024-01-03"), ("b", "2024-01-01")}
    first = got["a", "2024-01-01"]
    assert (first["total_active_minutes_day"], first["usb_count"], first["usb_after_hours_flag"]) == (60.0, 1, 1)
    # the 31st of December after the shift belongs to another month
    assert first["usb_device_diversity_monthly"] == 2
    web_only = got["a", "2024-01-03"]
    assert (web_only["job_site_visits_flag"], web_only["usb_count"], web_only["usb_device_diversity_monthly"]) == (1, 0, 0)
    assert web_only["usb_count_zscore_has_baseline"] is None
    assert got["b", "2024-01-01"]["usb_count_zscore_has_baseline"] == 0


def test_host_days_have_the_fixed_columns(spark):
    data = [
        (1, "a", at(8 * 3600), "System", "LOGON(STARTUP)", None, None, None),
        (2, "a", at(9 * 3600), "Security", "LOCK", None, None, None),
        (3, "a", at(10 * 3600), "UMDF", None, "CONNECT", "USB1", None),
        (4, "b", at(8 * 3600), "System", "LOGON(STARTUP)", None, None, None),
    ]
    events = spark.createDataFrame(
        data, "id long, user string, ts timestamp, source string, activity string, category string, device string, url string"
    )
    got = host_days(events)
    assert tuple(got.columns) == HOST_DAY_COLUMNS
    kept = got.collect()
    # b's only day has no after-hours session, no z-score, no device and no visit
    assert [(r["user"], r["day"], r["total_active_minutes_day"], r["usb_count"]) for r in kept] == [("a", "01/01/2024", 60.0, 1)]


def test_host_zone_moves_hours(spark):
    events = spark.createDataFrame(
        [(1, "a", at(6 * 3600), "UMDF", None, "CONNECT", "USB1", None)],
        "id long, user string, ts timestamp, source string, activity string, category string, device string, url string")
    assert host_days(events).first()["usb_after_hours_flag"] == 1
    assert host_days(events, zone="Asia/Dubai").first()["usb_after_hours_flag"] == 0


def test_alignment_and_profiles(spark):
    table = spark.createDataFrame([("a", DAY, 1.0, 0), ("b", DAY, None, 1)], "user string, day date, x double, insider_label int")
    got = rows(assemble.align(table, ["y", "x"]), "user", "y", "x")
    assert got == [("a", 0.0, 1.0), ("b", 0.0, 0.0)]
    profile = {r["feature"]: r for r in baseline.feature_profile(table, ["x", "gone"]).collect()}
    assert profile["x"]["mean"] == 1.0 and profile["gone"]["std"] == 0.1
    assert rows(assemble.unexpected_nulls(table, ["x"]), "feature", "nulls") == [("x", 1)]
