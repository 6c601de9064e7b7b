"""Corpus features: calendar, sessions, daily aggregates, baselines, the user-day table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.config import CalendarSettings, MODEL_FEATURES, PROFILE_FEATURES
from riskloom.functions.calendar import (
    after_hours, from_unix_micros, from_webkit_micros, lenient_timestamp, matches, minutes_between,
    month_of, shift_days, weekend,
)
from riskloom.operators import assemble, baseline, daily, scenarios
from riskloom.operators.labels import with_labels
from riskloom.operators.sessions import pair_adjacent
from riskloom.plans.corpus import corpus_days, logon_zscores
from riskloom.registry import views
from riskloom.registry.core import query, rounded
from riskloom.registry.sql_views import rounded as r
from riskloom.registry.sql_views import with_steps

U = 'usr as "user"'


@query(with_steps(
    f"""select {U}, day, logon_count, {r('logon_count_zscore')} from logon_z
    where logon_count_zscore is not null
    order by logon_z.logon_count_zscore desc, usr, day limit 20""", "logon_z"))
def top_logon_days(spark, sf):
    """The 20 user-days whose logon count departs most from the user's own history."""
    table = logon_zscores(views.logons(spark, sf), views.CORPUS_VIEW)
    return rounded(
        table.where(F.col("logon_count_zscore").isNotNull())
        .orderBy(F.col("logon_count_zscore").desc(), "user", "day").limit(20)
        .select("user", "day", "logon_count", "logon_count_zscore")
    )


@query(with_steps(f"""select id, {U}, cast(ts - interval 1 day as date) as day,
    cast(date_trunc('month', ts - interval 1 day) as date) as month,
    {'case when hour(ts) < 7 or hour(ts) >= 19 then 1 else 0 end'} as after_hours,
    case when isodow(ts - interval 1 day) - 1 in (4, 5) then 1 else 0 end as weekend from v_logon""", "v_logon"))
def calendar_flags(spark, sf):
    """Shifted day, month, after-hours and weekend of every logon row."""
    calendar = CalendarSettings(shift_days=-1)
    ts = shift_days(F.col("ts"), calendar.shift_days)
    return views.logons(spark, sf).select(
        "id", "user", F.to_date(ts).alias("day"), month_of(ts).cast("date").alias("month"),
        after_hours(ts, calendar).alias("after_hours"),
        weekend(ts, calendar.weekend_days).alias("weekend"),
    )


@query("""select event_id as id, case when event_id % 7 = 0 then null
    else date_trunc('second', ts) end as parsed, event_id % 7 = 0 as unparsed from events""")
def lenient_times(spark, sf):
    """Times written as text, some of them broken, parsed back."""
    events = views.table(spark, sf, "events")
    text = F.date_format("ts", "MM/dd/yyyy HH:mm:ss")
    broken = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), text)).otherwise(text)
    parsed = lenient_timestamp(broken, "MM/dd/yyyy HH:mm:ss")
    return events.select(
        F.col("event_id").alias("id"), parsed.cast("timestamp_ntz").alias("parsed"),
        parsed.isNull().alias("unparsed"),
    )


@query("""select event_id as id, cast(ts + interval 2 hour as date) as day, cast(hour(ts + interval 2 hour) as integer) as hour
    from events""")
def offset_times(spark, sf):
    """Times written with an offset of minus two hours, read as UTC."""
    events = views.table(spark, sf, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("-0200"))
    parsed = lenient_timestamp(text, "yyyy-MM-dd HH:mm:ss.SSSSSSZ")
    return events.select(
        F.col("event_id").alias("id"), F.to_date(parsed).alias("day"), F.hour(parsed).alias("hour")
    )


@query(with_steps("""select id, epoch_us(case when visit_us = 0 then null else ts end) as unix_us from (
    select b.id, b.visit_us, case when b.visit_us is not null then e.ts end as ts
    from v_browser b join ev e on e.id = b.id)""", "v_browser", "ev"))
def epoch_times(spark, sf):
    """Browser clocks from 1601 and 1970 as one time; 0 and null are unknown."""
    visits = views.browser_export(spark, sf)
    ts = F.when(F.col("browser") == "Firefox", from_unix_micros(F.col("visit_us"))).otherwise(
        from_webkit_micros(F.col("visit_us"))
    )
    return visits.select("id", F.unix_micros(ts).alias("unix_us"))


@query("""select page_id as id, case when regexp_matches(url, 'example\\.org', 'i') then 1 else 0 end as hit
    from pages""")
def keyword_matches(spark, sf):
    """Keyword flag of every page URL."""
    return views.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), matches(F.col("url"), views.JOB).alias("hit")
    )


@query(with_steps(f"select id, {U}, cast(ts - interval 1 day as date) as day, {r('minutes')} from logon_paired",
                  "logon_paired"))
def adjacent_sessions(spark, sf):
    """Minutes from each Logon to a Logoff that is the user's next row."""
    shifted = views.logons(spark, sf).withColumn("ts", shift_days(F.col("ts"), -1))
    paired = pair_adjacent(shifted, views.CORPUS_VIEW)
    return rounded(paired.select("id", "user", F.to_date("ts").alias("day"), F.col("session_minutes").alias("minutes")))


@query(with_steps(f"""select {U}, day, count(*) as n,
    round(sum((epoch_us(last_ts) - epoch_us(ts)) / 60000000.0), 8) as minutes
    from (select usr, cast(ts as date) as day, ts, max(ts) over (partition by usr, cast(ts as date)) as last_ts from v_logon)
    group by usr, day""", "v_logon"))
def minutes_to_last_row(spark, sf):
    """Minutes from every logon row to the last one of its day, summed per user-day."""
    rows = views.logons(spark, sf).withColumn("day", F.to_date("ts"))
    last = rows.groupBy("user", "day").agg(F.max("ts").alias("last_ts"))
    return rounded(
        rows.join(last, ["user", "day"]).groupBy("user", "day").agg(
            F.count(F.lit(1)).alias("n"), F.sum(minutes_between(F.col("ts"), F.col("last_ts"))).alias("minutes")
        )
    )


@query(with_steps(f"""select {U}, day, {r('total_active_minutes_day')}, after_hours_session_count,
    weekend_session_flag, logon_count from logon_day""", "logon_day"))
def daily_logon_features(spark, sf):
    """Session minutes, after-hours rows, weekend flag and logons per user-day."""
    return rounded(daily.daily_logon(views.logons(spark, sf), views.CORPUS_VIEW))


@query(with_steps(f"select {U}, day, usb_count, usb_after_hours_flag, usb_on_weekend_flag from device_day", "device_day"))
def daily_device_features(spark, sf):
    """Connects and flags per user-day."""
    return daily.daily_device(views.devices(spark, sf), views.CORPUS_VIEW)


@query(with_steps(f"select {U}, cast(month as date) as month, usb_device_diversity_monthly from device_month", "device_month"))
def monthly_machines(spark, sf):
    """Distinct machines with a connect per user and month."""
    return daily.monthly_diversity(daily.connects(views.devices(spark, sf)), "pc", views.CORPUS_VIEW)


@query(with_steps(f"select {U}, day, usb_count, usb_device_diversity_monthly from device_day", "device_day"))
def device_days_with_diversity(spark, sf):
    """Monthly machines attached to the device days."""
    devices = views.devices(spark, sf)
    diversity = daily.monthly_diversity(daily.connects(devices), "pc", views.CORPUS_VIEW)
    days = daily.daily_device(devices, views.CORPUS_VIEW).select("user", "day", "usb_count")
    return daily.attach_monthly(days, diversity)


@query(with_steps(f"select {U}, day, job_site_visits_flag from web_day", "web_day"))
def daily_web_features(spark, sf):
    """Job-site flag per user-day."""
    return daily.daily_web(views.visits(spark, sf), views.CORPUS_VIEW)


@query(with_steps(f"""select {U}, round(avg(logon_count), 6) as mean, round(stddev_samp(logon_count), 6) as std,
    count(logon_count) as count from logon_day group by usr""", "logon_day"))
def user_statistics(spark, sf):
    """Mean, deviation and days of the logon count per user."""
    return rounded(baseline.user_stats(daily.daily_logon(views.logons(spark, sf), views.CORPUS_VIEW), "logon_count"))


@query(with_steps("""select 'logon_count' as metric, round(avg(mean), 6) as population_mean,
    round(stddev_samp(mean), 6) as population_std, round(quantile_cont(std, 0.5), 6) as typical_user_std
    from (select avg(logon_count) as mean, stddev_samp(logon_count) as std from logon_day group by usr)""", "logon_day"))
def population_baseline(spark, sf):
    """Mean and deviation of the user means, median of the user deviations."""
    table = daily.daily_logon(views.logons(spark, sf), views.CORPUS_VIEW)
    return rounded(baseline.population_baseline(table, "logon_count"))


def _zscore_sql(minimum: int) -> str:
    has = f"s.std > 0 and s.n >= {minimum}"
    return with_steps(f"""select d.usr as "user", d.day, d.logon_count,
    case when {has} then round((d.logon_count - s.mean) / s.std, 6) end as logon_count_zscore,
    case when {has} then 1 else 0 end as logon_count_zscore_has_baseline
    from logon_day d join (select usr, avg(logon_count) as mean, stddev_samp(logon_count) as std, count(*) as n
      from logon_day group by usr) s using (usr)""", "logon_day")


def _zscores(spark, sf, minimum: int):
    table = daily.daily_logon(views.logons(spark, sf), views.CORPUS_VIEW)
    scored = baseline.with_zscore(table, "logon_count", "logon_count_zscore", minimum)
    return rounded(scored.select(
        "user", "day", "logon_count", "logon_count_zscore", "logon_count_zscore_has_baseline"
    ))


@query(_zscore_sql(5))
def logon_zscore(spark, sf):
    """Logon z-scores with the usual five days of history."""
    return _zscores(spark, sf, 5)


@query(_zscore_sql(15))
def logon_zscore_long_history(spark, sf):
    """Logon z-scores that need fifteen days of history."""
    return _zscores(spark, sf, 15)


@query(_zscore_sql(5))
def logon_zscore_from_saved_stats(spark, sf):
    """The same scores joined to a table of per-user statistics."""
    table = daily.daily_logon(views.logons(spark, sf), views.CORPUS_VIEW)
    stats = baseline.user_stats(table, "logon_count")
    scored = baseline.with_saved_zscore(table, stats, "logon_count", "logon_count_zscore", 5)
    return rounded(scored.select(
        "user", "day", "logon_count", "logon_count_zscore", "logon_count_zscore_has_baseline"
    ))


@query(with_steps(f"""select {U}, day, logon_count,
    round(least(greatest((logon_count - m) / s, -1.5), 1.5), 6) as population_zscore
    from logon_day, (select avg(mean) as m, quantile_cont(std, 0.5) as s from (
      select avg(logon_count) as mean, stddev_samp(logon_count) as std from logon_day group by usr))""", "logon_day"))
def population_zscore(spark, sf):
    """Logon counts scored against the population."""
    table = daily.daily_logon(views.logons(spark, sf), views.CORPUS_VIEW).select("user", "day", "logon_count")
    population = baseline.population_baseline(table, "logon_count")
    return rounded(baseline.population_zscore(table, population, "logon_count", "population_zscore"))


DAY_COLUMNS = """total_active_minutes_day logon_count_zscore usb_count_zscore"""
DAY_SQL = f"""select {U}, day, {r(DAY_COLUMNS)}, after_hours_session_count, weekend_session_flag,
    logon_count_zscore_has_baseline, usb_count, usb_after_hours_flag, usb_on_weekend_flag,
    usb_device_diversity_monthly, usb_count_zscore_has_baseline, job_site_visits_flag,
    job_search_plus_usb_week"""


def corpus(spark, sf):
    """The user-day table of the corpus views."""
    return corpus_days(
        views.logons(spark, sf), views.devices(spark, sf), views.visits(spark, sf), views.CORPUS_VIEW
    )


@query(with_steps(f"{DAY_SQL} from corpus", "corpus"))
def corpus_user_days(spark, sf):
    """The whole user-day table: three sources, baselines, fills and the weekly signal."""
    return rounded(corpus(spark, sf))


@query(with_steps(f"""select {U}, day, {r('total_active_minutes_day')}, after_hours_session_count, weekend_session_flag,
    logon_count, usb_count, usb_after_hours_flag, usb_on_weekend_flag, job_site_visits_flag from corpus_joined""",
                  "corpus_joined"))
def outer_joined_days(spark, sf):
    """Three daily tables joined by full outer joins."""
    settings = views.CORPUS_VIEW
    return rounded(assemble.outer_assemble(
        daily.daily_logon(views.logons(spark, sf), settings),
        daily.daily_device(views.devices(spark, sf), settings),
        daily.daily_web(views.visits(spark, sf), settings),
    ))


@query(with_steps(f"""select {U}, day, {', '.join(f'round(cast(coalesce({c}, 0) as double), 6) as {c}' for c in MODEL_FEATURES)}
    from corpus""", "corpus"))
def model_features(spark, sf):
    """Model inputs without nulls."""
    table = corpus(spark, sf)
    features = assemble.feature_columns(table)
    return rounded(assemble.imputed(table.select("user", "day", *features), features))


@query(with_steps(f"""select {U}, day, round(cast(coalesce(usb_count, 0) as double), 6) as usb_count, cast(0 as double) as email_count_zscore,
    round(coalesce(logon_count_zscore, 0), 6) as logon_count_zscore from corpus""", "corpus"))
def aligned_features(spark, sf):
    """The columns of another training run; one it lacks is 0."""
    trained = ["usb_count", "email_count_zscore", "logon_count_zscore"]
    return rounded(assemble.align(corpus(spark, sf), trained))


@query(with_steps("""select feature, n as nulls from (
    select 'total_active_minutes_day' as feature, count(*) filter (total_active_minutes_day is null) as n from corpus_joined
    union all select 'usb_count', count(*) filter (usb_count is null) from corpus_joined
    union all select 'job_site_visits_flag', count(*) filter (job_site_visits_flag is null) from corpus_joined)
    where n > 0""", "corpus_joined"))
def unexpected_nulls(spark, sf):
    """Features that hold nulls before the fill."""
    return assemble.unexpected_nulls(
        outer_joined_days(spark, sf), ["total_active_minutes_day", "usb_count", "job_site_visits_flag"]
    )


@query(with_steps(" union all ".join(
    f"""select '{c}' as feature, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
    round(cast(min({c}) as double), 6) as min, round(cast(max({c}) as double), 6) as max
    from labelled where insider_label = 0""" for c in PROFILE_FEATURES
) + " union all select 'email_count', 0.0, 0.1, 0.0, 1.0", "labelled"))
def normal_profile(spark, sf):
    """Distribution of every feature over unlabelled days; one the table lacks gets defaults."""
    table = with_labels(corpus(spark, sf), views.incidents(spark, sf), views.VERSION)
    return rounded(baseline.feature_profile(table, [*PROFILE_FEATURES, "email_count"]))


def _scenario_sql(extra=("", "", "")) -> str:
    return with_steps(f"""select {U}, day, array_to_string(list_filter([
      case when after_hours_session_count between 2 and 5 and usb_count between 3 and 7 and usb_after_hours_flag = 1
        and job_site_visits_flag = 0 and job_search_plus_usb_week = 0 {extra[0]} then 1 end,
      case when job_site_visits_flag = 1 and usb_count between 4 and 9 and job_search_plus_usb_week = 1
        and after_hours_session_count between 0 and 1 {extra[1]} then 2 end,
      case when after_hours_session_count between 3 and 6 and usb_count between 2 and 4 and usb_after_hours_flag = 1
        and job_site_visits_flag = 0 {extra[2]} then 3 end], lambda x: x is not null), ',') as scenarios from corpus""", "corpus")


def _scenario_days(spark, sf, with_zscore: bool):
    tagged = scenarios.with_scenarios(corpus(spark, sf), with_zscore)
    return tagged.select(
        "user", "day", F.array_join(F.col("scenarios").cast("array<string>"), ",").alias("scenarios")
    )


@query(_scenario_sql())
def scenario_matches(spark, sf):
    """User-days that fit a known incident scenario."""
    return _scenario_days(spark, sf, False)


@query(_scenario_sql(tuple(f"and usb_count_zscore between {a} and {b}" for a, b in ((2.5, 4.5), (2, 4), (1.5, 3.5)))))
def scenario_matches_with_zscore(spark, sf):
    """Scenario matches that also need an unusual connect count."""
    return _scenario_days(spark, sf, True)
