"""User reports, rankings and the queries a dashboard reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scores import is_flagged, risk_tier, to_double, to_int, to_strict_int
from riskloom.operators.ordering import global_rank
from riskloom.operators.scoring import with_composite_rank_score


def peak_day(score: str = "combined_risk_score", day: str = "day") -> Column:
    """Aggregate: the day of the highest score, the earliest one on ties."""
    return F.max_by(F.col(day), F.struct(F.col(score), -F.unix_date(day)))


def peak_days(table: DataFrame) -> DataFrame:
    """Peak day and score per user."""
    return table.groupBy("user").agg(
        peak_day().alias("peak_date"), F.max("combined_risk_score").alias("peak_score")
    )


def _flag_counts() -> list[Column]:
    return [
        F.count_if(is_flagged(F.col("iso_prediction"))).alias("days_flagged_iso"),
        F.count_if(is_flagged(F.col("lof_prediction"))).alias("days_flagged_lof"),
        F.sum("flagged_by_both").alias("days_flagged_both"),
    ]


def training_report(table: DataFrame, usb: str = "usb_count_zscore") -> DataFrame:
    """Per-user maxima and counts in one aggregate, ranked by the highest risk."""
    users = table.groupBy("user").agg(
        F.max("combined_risk_score").alias("final_risk_score"),
        F.max("supervised_score").alias("supervised_max"),
        F.avg("supervised_score").alias("supervised_mean"),
        F.max("unsupervised_score").alias("unsupervised_max"),
        *_flag_counts(),
        F.sum("insider_label").alias("known_insider_days"),
        peak_day().alias("peak_date"),
        F.count_if(F.col("job_site_visits_flag") == 1).alias("job_search_days"),
        F.count_if(F.col(usb) > 0).alias("usb_days"),
    )
    return ranked(users, "final_risk_score")


def deployment_report(table: DataFrame) -> DataFrame:
    """Per-user means and counts by cohort, ranked by the mean anomaly score."""
    users = table.groupBy("user", "is_synthetic").agg(
        F.sum("above_threshold").alias("days_above_threshold"),
        F.avg("combined_risk_score").alias("final_risk_score"),
        F.max("supervised_score").alias("supervised_max"),
        F.avg("supervised_score").alias("supervised_mean"),
        F.max("unsupervised_score").alias("unsupervised_max"),
        F.avg("unsupervised_score").alias("unsupervised_mean"),
        F.avg("iso_score_norm").alias("iso_score_norm_mean"),
        F.avg("lof_score_norm").alias("lof_score_norm_mean"),
        *_flag_counts(),
        F.count("combined_risk_score").alias("total_days"),
        F.max(F.struct("combined_risk_score", (-F.unix_date("day")).alias("before"))).alias("__peak"),
    )
    # The peak day is the user's over all cohorts.
    user = Window.partitionBy("user")
    users = users.withColumn("__best", F.max("__peak").over(user)).withColumn(
        "peak_date", F.date_from_unix_date(-F.col("__best.before"))
    ).drop("__peak", "__best")
    return ranked(with_composite_rank_score(users), "unsupervised_mean", "is_synthetic")


def ranked(users: DataFrame, score: str, *more: str) -> DataFrame:
    """Rank 1..n by descending score; the user name settles ties."""
    order = [F.col(score).desc_nulls_last(), F.col("user"), *[F.col(c) for c in more]]
    return global_rank(users, order)


def top_users(users: DataFrame, n: int, score: str) -> DataFrame:
    """Head of the ranking: every task keeps n rows."""
    return users.orderBy(F.col(score).desc_nulls_last(), "user").limit(n)


def top_days(table: DataFrame, n: int = 3, *more: str) -> DataFrame:
    """The user's n highest-risk days; tasks drop lower days before the shuffle."""
    order = Window.partitionBy("user").orderBy(
        F.col("combined_risk_score").desc_nulls_last(), F.col("day"), *[F.col(c) for c in more]
    )
    return table.withColumn("day_rank", F.row_number().over(order)).where(F.col("day_rank") <= n)


def leaderboard(users: DataFrame) -> DataFrame:
    """Users by mean anomaly score, with position and tier."""
    score = F.coalesce("unsupervised_mean", "unsupervised_max", F.lit(0.0))
    scored = users.select(
        "user", score.alias("score"), risk_tier(score).alias("tier"), "days_flagged_both"
    )
    return global_rank(scored, [F.col("score").desc(), F.col("user")], "position")


def user_timeline(table: DataFrame, *more: str) -> DataFrame:
    """Scores in percent by date and a breach flag; filter a user to draw one line."""
    percent = {
        "combined_pct": "combined_risk_score", "iso_pct": "iso_score_norm", "lof_pct": "lof_score_norm"
    }
    return table.select(
        "user", "day", *more,
        *[F.round(F.col(c) * 100, 1).alias(n) for n, c in percent.items()],
        (F.col("above_threshold") == 1).cast("int").alias("breach"),
    )


def recent_days(table: DataFrame, n: int = 20, *more: str) -> DataFrame:
    """The user's n latest days with detector flags."""
    order = Window.partitionBy("user").orderBy(F.col("day").desc(), *[F.col(c).desc() for c in more])
    return (
        table.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)
        .select(
            "user", "day", "recency", *more, "combined_risk_score",
            is_flagged(F.col("iso_prediction")).cast("int").alias("iso_flag"),
            is_flagged(F.col("lof_prediction")).cast("int").alias("lof_flag"),
            "flagged_by_both", "above_threshold",
        )
    )


def latest_row(table: DataFrame, columns: Sequence[str], *more: str) -> DataFrame:
    """The named columns of the user's latest row."""
    return table.groupBy("user").agg(
        F.max("day").alias("day"),
        F.max_by(F.struct(*columns), F.struct("day", *more)).alias("r"),
    ).select("user", "day", "r.*")


def breach_summary(table: DataFrame, n: int = 3) -> DataFrame:
    """Breaches per user and the n latest breach days; at most n days are collected."""
    days = table.groupBy("user", "day").agg(F.sum("above_threshold").alias("hits"))
    latest = Window.partitionBy("user").orderBy(F.col("day").desc())
    recent = (
        days.where(F.col("hits") > 0)
        .withColumn("r", F.row_number().over(latest)).where(F.col("r") <= n)
        .groupBy("user")
        .agg(F.array_join(F.sort_array(F.collect_list(F.col("day").cast("string"))), ",").alias("last_breaches"))
    )
    counts = days.groupBy("user").agg(F.sum("hits").alias("breaches"))
    return counts.join(recent, "user", "left")


def run_summary(table: DataFrame) -> DataFrame:
    """One row: flagged rows, rows above the threshold, and the real cohort's share of both."""
    real = F.col("is_synthetic") == 0
    breach = F.col("above_threshold") == 1
    return table.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("user").alias("users"),
        F.count_if(is_flagged(F.col("iso_prediction"))).alias("flagged_iso"),
        F.count_if(is_flagged(F.col("lof_prediction"))).alias("flagged_lof"),
        F.count_if(F.col("flagged_by_both") == 1).alias("flagged_both"),
        F.count_if(breach).alias("above_threshold"),
        F.count_if(real).alias("real_rows"), F.count_if(real & breach).alias("real_above_threshold"),
    )


# How a dashboard types the columns of each table.
USER_INTS = ("rank", "is_synthetic", "days_flagged_iso", "days_flagged_lof", "days_flagged_both")
USER_DOUBLES = (
    "final_risk_score", "supervised_max", "supervised_mean", "unsupervised_max",
    "unsupervised_mean", "iso_score_norm_mean", "lof_score_norm_mean",
)
# The two counts below stay text in older readers; here they are numbers as well.
USER_MORE_INTS = ("days_above_threshold", "total_days")
DAY_INTS = (
    "after_hours_session_count", "weekend_session_flag", "is_synthetic", "iso_prediction",
    "lof_prediction", "flagged_by_both", "above_threshold", "job_site_visits_flag",
    "job_search_plus_usb_week", "usb_after_hours_flag", "usb_on_weekend_flag",
    "logon_count_zscore_has_baseline", "usb_count_zscore_has_baseline",
)
DAY_DOUBLES = (
    "total_active_minutes_day", "logon_count_zscore", "usb_count",
    "usb_device_diversity_monthly", "usb_count_zscore", "supervised_score",
    "unsupervised_score", "combined_risk_score", "iso_score", "lof_score",
    "iso_score_norm", "lof_score_norm",
)


def _typed(table: DataFrame, casts: Mapping) -> DataFrame:
    return table.withColumns({
        c: cast(F.col(c)) for cast, columns in casts.items() for c in columns if c in table.columns
    })


def users_table(users: DataFrame) -> DataFrame:
    """User report with every column typed; what does not parse is 0."""
    return _typed(users, {to_strict_int: USER_INTS + USER_MORE_INTS, to_double: USER_DOUBLES})


def days_table(table: DataFrame) -> DataFrame:
    """Scored days with every column typed; whole numbers are cut towards zero."""
    return _typed(table, {to_int: DAY_INTS, to_double: DAY_DOUBLES})


def attribution_table(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Attributions with every column typed."""
    return _typed(table, {to_double: features})
