"""Host log: filters, noise rules, sessions and the host user-day table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.calendar import minutes_between
from riskloom.operators import cleaning
from riskloom.operators.daily import connects, monthly_diversity
from riskloom.operators.sessions import host_session_days, host_sessions
from riskloom.plans.host import exported_host_log, host_days, host_report_days
from riskloom.registry import views
from riskloom.registry.core import query, rounded
from riskloom.registry.sql_views import rounded as r
from riskloom.registry.sql_views import STEPS, with_steps
from riskloom.sources.logs import union_sources

U = 'usr as "user"'
_EVENT = f"select id, {U}, source, event_id, activity, device from"


def _shown(events):
    return events.select("id", "user", "source", "event_id", "activity", "device")


@query(with_steps(f"select id, {U}, pc from v_device where activity = 'Connect'", "v_device"))
def device_connects(spark, sf):
    """Device rows that are connects."""
    return connects(views.devices(spark, sf)).select("id", "user", "pc")


@query(with_steps(f"{_EVENT} v_host where source in ('Security', 'System')", "v_host"))
def session_source_events(spark, sf):
    """Rows of the two session sources."""
    return _shown(cleaning.by_source(views.host_events(spark, sf), "Security", "System"))


@query(with_steps(f"""{_EVENT} v_host where source <> 'UMDF' or regexp_matches(coalesce(device, ''), '^USB_VID_', 'i')""",
                  "v_host"))
def usb_device_events(spark, sf):
    """Host rows without foreign devices."""
    return _shown(cleaning.usb_only(views.host_events(spark, sf), views.DEVICE_VIEW_PATTERN))


@query(with_steps(f"{_EVENT} v_host where ts >= timestamp '2024-01-31 00:00:00' - interval 10 day", "v_host"))
def recent_events(spark, sf):
    """Host rows of the last ten days before a given time."""
    as_of = F.to_timestamp(F.lit(views.AS_OF))
    return _shown(cleaning.within_lookback(views.host_events(spark, sf), as_of, 10))


@query(with_steps(f"""select id, {U}, activity, pc, null::varchar as url from v_logon
    union all select id, {U}, activity, pc, null from v_device
    union all select id, {U}, null, null, url from v_http""", "v_logon", "v_device", "v_http"))
def stacked_sources(spark, sf):
    """Three logs with different columns in one table."""
    parts = [
        views.logons(spark, sf).drop("ts"), views.devices(spark, sf).drop("ts"),
        views.visits(spark, sf).drop("ts", "method"),
    ]
    return union_sources(*parts).select("id", "user", "activity", "pc", "url")


@query(with_steps("""select id, category from v_host
    where source = 'UMDF' and id in (select id from kept_usb_raw)""", "v_host", "kept_usb_raw"))
def usb_burst_dedup(spark, sf):
    """Device rows left once repeats and bounces of the last kept row are gone."""
    events = cleaning.by_source(views.host_events(spark, sf), "UMDF")
    return cleaning.usb_dedup(events, settings=views.CLEANING_VIEW).select("id", "category")


@query(with_steps("""select id from v_host where activity is distinct from 'LOGON(STARTUP)'
    or id in (select id from kept_startup)""", "v_host", "kept_startup"))
def startup_dedup(spark, sf):
    """Host rows left once repeated startups are gone."""
    return cleaning.startup_dedup(views.host_events(spark, sf), settings=views.CLEANING_VIEW).select("id")


@query(with_steps("select id from boot_kept", "boot_kept"))
def boot_logon_noise(spark, sf):
    """Host rows left once logons right after a kept startup are gone."""
    events = cleaning.startup_dedup(views.host_events(spark, sf), settings=views.CLEANING_VIEW)
    return cleaning.without_boot_logons(events, settings=views.CLEANING_VIEW).select("id")


@query(with_steps(f"""select {U}, day, id, activity,
    round((epoch_us(close_ts) - epoch_us(open_ts)) / 60000000.0, 8) as minutes from host_all_session""",
                  "host_all_session"))
def open_close_sessions(spark, sf):
    """Sessions of the open/close rule with their length, null while open."""
    events = cleaning.by_source(views.host_events(spark, sf), "Security", "System")
    return rounded(host_sessions(events).select(
        "user", "day", "id", "activity", minutes_between(F.col("open_ts"), F.col("close_ts")).alias("minutes")
    ))


@query(with_steps(f"""select {U}, day, {r('total_active_minutes_day')}, after_hours_session_count,
    weekend_session_flag, logon_count from host_all_logon""", "host_all_logon"))
def host_session_totals(spark, sf):
    """Host session totals per user-day."""
    events = cleaning.by_source(views.host_events(spark, sf), "Security", "System")
    return rounded(host_session_days(events))


@query(with_steps(f"""select {U}, cast(date_trunc('month', ts) as date) as month,
    count(distinct device) as usb_device_diversity_monthly from v_host
    where source = 'UMDF' and category = 'CONNECT' group by 1, 2""", "v_host"))
def monthly_devices(spark, sf):
    """Distinct devices per user and month, the host form of the diversity signal."""
    events = views.categorised(views.host_events(spark, sf)).where(F.col("category") == "CONNECT")
    return monthly_diversity(events, "device", views.HOST_VIEW)


def _host_sql(step: str) -> str:
    return with_steps(f"""select day as date, {U}, strftime(day, '%m/%d/%Y') as day,
    {r('total_active_minutes_day logon_count_zscore usb_count_zscore')}, after_hours_session_count,
    weekend_session_flag, logon_count_zscore_has_baseline, usb_count, usb_after_hours_flag, usb_on_weekend_flag,
    usb_device_diversity_monthly, usb_count_zscore_has_baseline, job_site_visits_flag, job_search_plus_usb_week
    from {step}""", step)


@query(_host_sql("host_all_days"))
def host_user_days(spark, sf):
    """The host user-day table of categorised events."""
    return rounded(host_days(views.categorised(views.host_events(spark, sf)), views.HOST_VIEW))


@query(_host_sql("host_clean_days"))
def cleaned_host_user_days(spark, sf):
    """Raw host events through every noise rule to the host user-day table."""
    return rounded(host_report_days(
        views.host_events(spark, sf), views.DEVICE_VIEW_PATTERN, views.HOST_VIEW, views.CLEANING_VIEW
    ))


# The exports of the host log: devices missing now and then, visits instead of browser rows.
_EXPORTED = f"""select * replace (case when source = 'UMDF' and k % 4 = 3 then 'N/A' else device end as device)
  from ({STEPS['v_host'][0]}) where source <> 'Browser' union all by name
  select id, usr, 'Browser' as source, url, k, ts from (select b.*, e.ts, e.k from ({STEPS['v_browser'][0]}) b join ev e on e.id = b.id)
  where coalesce(visit_us, 0) > 0 and (browser <> 'Firefox' or visit_count > 0)
    and ts >= timestamp '2024-01-31 00:00:00' - interval 12 day"""


@query(_host_sql("host_clean_days").replace(STEPS["v_host"][0], _EXPORTED))
def exported_log_user_days(spark, sf):
    """Exported XML and browser visits, joined, cleaned and turned into host user-days."""
    raw = views.event_xml(spark, sf)
    log = exported_host_log(
        raw.where(F.col("source") == "UMDF").drop("source"), raw.where(F.col("source").isin("Security", "System")),
        views.browser_export(spark, sf), F.to_timestamp(F.lit(views.AS_OF)), 12,
    )
    return rounded(host_report_days(log, views.DEVICE_VIEW_PATTERN, views.HOST_VIEW, views.CLEANING_VIEW))
