"""Score fusion, thresholds, reports and dashboard queries on surrogate scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.scores import above, both_flagged, to_double, to_int, to_strict_int
from riskloom.operators import explain, reports, scoring, supervised
from riskloom.registry import views
from riskloom.registry.core import query, rounded
from riskloom.registry.sql_views import rounded as r
from riskloom.registry.sql_views import with_steps

U = 'usr as "user"'
ISO_RANGE = (-3.0, 0.0)


def fused(spark, sf):
    """Scores fused as in training."""
    return scoring.fused(views.scores(spark, sf))


def deployed(spark, sf):
    """Scores fused as in deployment."""
    return scoring.fused_for_deployment(views.scores(spark, sf), ISO_RANGE)


@query(with_steps("""select id, round(1 - (iso_score - iso_lo) / (iso_hi - iso_lo), 6) as inverted,
    round((iso_score - iso_lo) / (iso_hi - iso_lo), 6) as plain, cast(0 as double) as constant
    from v_scores, score_range""", "v_scores", "score_range"))
def normalised_scores(spark, sf):
    """Min-max shares, inverted, plain and of a constant score."""
    table = views.scores(spark, sf).select("id", "iso_score", F.lit(3.0).alias("same"))
    table = scoring.normalised(table, "iso_score", "inverted")
    table = scoring.normalised(table, "iso_score", "plain", invert=False)
    return rounded(scoring.normalised(table, "same", "constant").drop("iso_score", "same"))


_FUSED = "iso_score_norm lof_score_norm unsupervised_score combined_risk_score"


@query(with_steps(f"select id, {r(_FUSED)}, flagged_by_both from fused", "fused"))
def fused_scores(spark, sf):
    """Training fusion with the consensus bonus."""
    return rounded(fused(spark, sf).select("id", *_FUSED.split(), "flagged_by_both"))


@query(with_steps(f"select id, {r(_FUSED)}, flagged_by_both, above_threshold from deployed", "deployed"))
def deployment_scores(spark, sf):
    """Deployment fusion against a saved range."""
    return rounded(deployed(spark, sf).select("id", *_FUSED.split(), "flagged_by_both", "above_threshold"))


@query(with_steps("""select id, case when supervised_score >= 0.3793 then 1 else 0 end as above_threshold,
    case when iso_prediction = -1 and lof_prediction = -1 then 1 else 0 end as flagged_by_both from v_scores""", "v_scores"))
def threshold_flags(spark, sf):
    """Threshold and agreement flags."""
    return views.scores(spark, sf).select(
        "id", above(F.col("supervised_score"), 0.3793).alias("above_threshold"),
        both_flagged(F.col("iso_prediction"), F.col("lof_prediction")).alias("flagged_by_both"),
    )


@query(with_steps(f"""select {', '.join(
    f'round(quantile_cont({c}, {p}), 6) as {n}' for n, (c, p) in scoring.THRESHOLD_QUANTILES.items())},
    round(min(iso_score), 6) as iso_score_min, round(max(iso_score), 6) as iso_score_max,
    round(min(lof_score), 6) as lof_score_min, round(max(lof_score), 6) as lof_score_max,
    cast(0.02 as double) as contamination_used, count(*) as training_rows, count(distinct usr) as training_users,
    '4.2' as corpus_version, round(quantile_cont(combined_risk_score, 0.98), 6) as recommended_threshold
    from fused""", "fused"))
def exported_thresholds(spark, sf):
    """Exact percentiles, score ranges and sizes."""
    return rounded(scoring.thresholds(fused(spark, sf), views.VERSION))


@query(with_steps(f"""select row_number() over (order by max(combined_risk_score) desc, usr) as rank, {U},
    round(max(combined_risk_score), 6) as final_risk_score, round(max(supervised_score), 6) as supervised_max,
    round(avg(supervised_score), 6) as supervised_mean, round(max(unsupervised_score), 6) as unsupervised_max,
    count(*) filter (iso_prediction = -1) as days_flagged_iso, count(*) filter (lof_prediction = -1) as days_flagged_lof,
    cast(sum(flagged_by_both) as bigint) as days_flagged_both, cast(sum(insider_label) as bigint) as known_insider_days,
    arg_max(day, (combined_risk_score, -epoch(day))) as peak_date,
    count(*) filter (job_site_visits_flag = 1) as job_search_days, count(*) filter (usb_count_zscore > 0) as usb_days
    from fused group by usr""", "fused"))
def training_user_report(spark, sf):
    """User report of a training run, ranked."""
    return rounded(reports.training_report(fused(spark, sf)))


_MEANS = """final_risk_score supervised_max supervised_mean unsupervised_max unsupervised_mean iso_score_norm_mean
    lof_score_norm_mean composite_rank_score"""
_REPORT = f"""select rank, {U}, is_synthetic, days_above_threshold, {r(_MEANS)}, days_flagged_iso, days_flagged_lof,
    days_flagged_both, total_days, peak_date from deploy_report"""


@query(with_steps(_REPORT, "deploy_report"))
def deployment_user_report(spark, sf):
    """User report of a deployment run with the composite score, ranked."""
    return rounded(reports.deployment_report(deployed(spark, sf)))


_COUNTS = "is_synthetic rank days_above_threshold days_flagged_iso days_flagged_lof days_flagged_both total_days"


@query(with_steps(f"""select * replace ({', '.join(f'cast({c} as bigint) as {c}' for c in _COUNTS.split())})
    from ({_REPORT})""", "deploy_report"))
def users_served(spark, sf):
    """The user report as text, typed again column by column."""
    table = rounded(reports.deployment_report(deployed(spark, sf)))
    text = table.select(*[
        c if c in ("user", "peak_date") else F.col(c).cast("string").alias(c) for c in table.columns
    ]).withColumn("composite_rank_score", to_double(F.col("composite_rank_score")))
    return reports.users_table(text)


_FLAGS = "flagged_by_both above_threshold iso_prediction lof_prediction"


@query(with_steps(f"""select id, {U}, {r(_FUSED)}, {', '.join(f'cast({c} as bigint) as {c}' for c in _FLAGS.split())},
    3000000000 + cast(trunc(supervised_score * 10) as bigint) as after_hours_session_count,
    cast(0 as bigint) as weekend_session_flag from deployed""", "deployed"))
def days_served(spark, sf):
    """Scored days as text, typed again; fractions are cut and broken numbers are 0."""
    table = rounded(deployed(spark, sf).select(
        "id", "user", *_FUSED.split(), "flagged_by_both", "above_threshold", "iso_prediction", "lof_prediction",
        F.col("supervised_score").alias("__s"),
    ))
    text = table.select("id", "user", *[F.col(c).cast("string").alias(c) for c in table.columns[2:-1]]).join(
        deployed(spark, sf).select(
            "id", (F.floor(F.col("supervised_score") * 10) + 3_000_000_000).cast("string").alias("after_hours_session_count"),
            F.lit("n/a").alias("weekend_session_flag"),
        ), "id",
    )
    return reports.days_table(text)


@query(with_steps(f"""select {U}, day as peak_date, round(combined_risk_score, 6) as peak_score from (
    select *, row_number() over (partition by usr order by combined_risk_score desc, day) as rn from fused) where rn = 1""",
                  "fused"))
def peak_days(spark, sf):
    """The user's worst day, the earliest on ties."""
    return rounded(reports.peak_days(fused(spark, sf)))


@query(with_steps(f"""select id, {U}, day, round(combined_risk_score, 6) as combined_risk_score, day_rank from (
    select *, row_number() over (partition by usr order by combined_risk_score desc, day, id) as day_rank from fused)
    where day_rank <= 3""", "fused"))
def top_days_per_user(spark, sf):
    """Three highest rows per user."""
    top = reports.top_days(fused(spark, sf), 3, "id")
    return rounded(top.select("id", "user", "day", "combined_risk_score", F.col("day_rank").cast("long")))


@query(with_steps(f"""select {U}, round(max(combined_risk_score), 6) as final_risk_score from fused group by usr
    order by max(combined_risk_score) desc, usr limit 20""", "fused"))
def top_risk_users(spark, sf):
    """Head of the ranking."""
    users = fused(spark, sf).groupBy("user").agg(F.max("combined_risk_score").alias("final_risk_score"))
    return rounded(reports.top_users(users, 20, "final_risk_score"))


_SIGNED = ["iso_score", "lof_score", "supervised_score", "usb_count_zscore", "unsupervised_score", "combined_risk_score"]


@query(with_steps(f"""select id, feature, feature_rank, round(contribution, 6) as contribution,
    case when contribution > 0 then 'up' else 'down' end as direction from (
      select *, row_number() over (partition by id order by abs(contribution) desc, place) as feature_rank from (
        {' union all '.join(f"select id, '{c}' as feature, {i} as place, {c} as contribution from fused"
                            for i, c in enumerate(_SIGNED))}))
    where feature_rank <= 5""", "fused"))
def top_features_per_day(spark, sf):
    """Five largest contributions of each row, here the scores themselves."""
    table = fused(spark, sf).select("id", *_SIGNED)
    top = explain.top_features(table, _SIGNED, 5)
    return rounded(top.withColumn("feature_rank", F.col("feature_rank").cast("long")))


_BOARD = """select usr, unsupervised_mean as score,
    case when unsupervised_mean >= 0.75 then 'critical' when unsupervised_mean >= 0.40 then 'high' else 'medium' end as tier,
    days_flagged_both from (select usr, avg(unsupervised_score) as unsupervised_mean,
      cast(sum(flagged_by_both) as bigint) as days_flagged_both from deployed group by usr)"""


@query(with_steps(f"""select row_number() over (order by score desc, usr) as position, {U}, {r('score')}, tier,
    days_flagged_both from ({_BOARD})""", "deployed"))
def leaderboard(spark, sf):
    """Users by mean anomaly score with position and tier."""
    users = deployed(spark, sf).groupBy("user").agg(
        F.avg("unsupervised_score").alias("unsupervised_mean"),
        F.max("unsupervised_score").alias("unsupervised_max"),
        F.sum("flagged_by_both").alias("days_flagged_both"),
    )
    return rounded(reports.leaderboard(users))


@query(with_steps(f"""select id, {U}, day, round(combined_risk_score * 100, 1) as combined_pct,
    round(iso_score_norm * 100, 1) as iso_pct, round(lof_score_norm * 100, 1) as lof_pct,
    above_threshold as breach from deployed""", "deployed"))
def user_timelines(spark, sf):
    """Scores in percent by day, for every user."""
    return reports.user_timeline(deployed(spark, sf), "id")


@query(with_steps(f"""select id, {U}, day, recency, round(combined_risk_score, 6) as combined_risk_score,
    cast(iso_prediction = -1 as integer) as iso_flag, cast(lof_prediction = -1 as integer) as lof_flag,
    flagged_by_both, above_threshold from (
      select *, row_number() over (partition by usr order by day desc, id desc) as recency from deployed)
    where recency <= 20""", "deployed"))
def latest_flags(spark, sf):
    """Twenty latest rows per user with flags."""
    recent = reports.recent_days(deployed(spark, sf), 20, "id")
    return rounded(recent.withColumn("recency", F.col("recency").cast("long")))


@query(with_steps(f"""select {U}, day, round(iso_score, 6) as iso_score, round(lof_score, 6) as lof_score from (
    select *, row_number() over (partition by usr order by day desc, id desc) as rn from deployed) where rn = 1""",
                  "deployed"))
def latest_attribution(spark, sf):
    """The named columns of each user's latest row."""
    return rounded(reports.latest_row(deployed(spark, sf), ["iso_score", "lof_score"], "id"))


@query(with_steps(f"""select {U}, cast(coalesce(sum(hits), 0) as bigint) as breaches,
    string_agg(case when hits > 0 and rn <= 3 then cast(day as varchar) end, ',' order by day) as last_breaches from (
      select *, row_number() over (partition by usr, hits > 0 order by day desc) as rn from (
        select usr, day, sum(above_threshold) as hits from deployed group by usr, day))
    group by usr""", "deployed"))
def breach_summary(spark, sf):
    """Breaches and the three latest breach days per user."""
    return reports.breach_summary(deployed(spark, sf))


@query(with_steps("""select count(*) as rows, count(distinct usr) as users,
    count(*) filter (iso_prediction = -1) as flagged_iso, count(*) filter (lof_prediction = -1) as flagged_lof,
    count(*) filter (flagged_by_both = 1) as flagged_both, count(*) filter (above_threshold = 1) as above_threshold,
    count(*) filter (is_synthetic = 0) as real_rows,
    count(*) filter (is_synthetic = 0 and above_threshold = 1) as real_above_threshold from deployed""", "deployed"))
def run_summary(spark, sf):
    """Counts of one run."""
    return reports.run_summary(deployed(spark, sf))


@query(with_steps(f"""select id, {U}, 0 as cohort, activity from v_logon
    union all select id, {U}, 1 as cohort, activity from v_device""", "v_logon", "v_device"))
def stacked_cohorts(spark, sf):
    """Two populations with a cohort flag."""
    first = views.logons(spark, sf).select("id", "user", F.lit(0).alias("cohort"), "activity")
    second = views.devices(spark, sf).select("id", "user", F.lit(1).alias("cohort"), "activity")
    return first.unionByName(second)


@query("""select event_id as id, cast(trunc(value) as bigint) as cut, value as number,
    cast(0 as bigint) as broken, cast(case when value = trunc(value) then trunc(value) else 0 end as bigint) as strict,
    3000000000000 + event_id as large, -3000000000000 - event_id as large_cut from events""")
def coerced_numbers(spark, sf):
    """Numbers from text: cut, whole only, broken, and beyond 32 bits."""
    events = views.table(spark, sf, "events")
    text = F.col("value").cast("string")
    whole = F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(text)
    large = (F.lit(3_000_000_000_000) + F.col("event_id")).cast("string")
    return events.select(
        F.col("event_id").alias("id"), to_int(text).alias("cut"), to_double(text).alias("number"),
        to_int(F.concat(F.lit("x"), text)).alias("broken"), to_strict_int(whole).alias("strict"),
        to_strict_int(large).alias("large"), to_int(F.concat(F.lit("-"), large, F.lit(".5"))).alias("large_cut"),
    )


_ATTR = ["iso_score", "lof_score", "usb_count_zscore"]


@query(with_steps(f"""select id, round(iso_score, 6) as iso_score, round(lof_score, 6) as lof_score,
    case when id % 9 = 0 then 0 else round(usb_count_zscore, 6) end as usb_count_zscore from v_scores""", "v_scores"))
def attributions_served(spark, sf):
    """Attributions as text, typed again; a broken one is 0."""
    table = rounded(views.scores(spark, sf).select("id", *_ATTR))
    text = table.select("id", *[
        F.when((F.col("id") % 9 == 0) & F.lit(c == "usb_count_zscore"), "broken")
        .otherwise(F.col(c).cast("string")).alias(c) for c in _ATTR
    ])
    return reports.attribution_table(text, _ATTR)


@query(with_steps("""select case when p * n = 0 then 0.5 else round((ranks - p * (p + 1) / 2) / (p * n), 6) end as roc_auc from (
    select sum(case when insider_label = 1 then rk end) as ranks, count(*) filter (insider_label = 1) as p,
      count(*) filter (insider_label = 0) as n from (
      select insider_label, rank() over (order by supervised_score)
        + (count(*) over (partition by supervised_score) - 1) / 2.0 as rk from v_scores))""", "v_scores"))
def exact_roc_auc(spark, sf):
    """Rank AUC with ties averaged."""
    return rounded(supervised.roc_auc(views.scores(spark, sf)))


@query(with_steps("""select round(count(*) filter (is_insider = 1) / 20.0, 6) as precision_at_k from (
    select usr, max(supervised_score) as best, max(insider_label) as is_insider from v_scores group by usr
    order by best desc, usr limit 20)""", "v_scores"))
def precision_at_20(spark, sf):
    """Share of insiders among the 20 users with the highest score."""
    table = views.scores(spark, sf)
    insiders = table.groupBy("user").agg(F.max("insider_label").alias("is_insider"))
    return rounded(supervised.precision_at(table, insiders))


@query(with_steps("""select round(tp / greatest(tp + fp, 1), 6) as precision, round(tp / greatest(tp + fn, 1), 6) as recall,
    round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) as f1 from (
    select count(*) filter (supervised_score > 0.5 and insider_label = 1) as tp,
      count(*) filter (supervised_score > 0.5 and insider_label = 0) as fp,
      count(*) filter (not supervised_score > 0.5 and insider_label = 1) as fn from v_scores)""", "v_scores"))
def decision_metrics(spark, sf):
    """Precision, recall and F1 at one half."""
    return rounded(supervised.threshold_metrics(views.scores(spark, sf)))
