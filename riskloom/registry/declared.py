"""Declared user-day features."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import declared
from riskloom.operators.assemble import with_weekly_compound
from riskloom.operators.daily import connects, daily_device
from riskloom.registry import views
from riskloom.registry.core import query, rounded
from riskloom.registry.features import corpus
from riskloom.registry.sql_views import rounded as r
from riskloom.registry.sql_views import with_steps

U = 'usr as "user"'
OWN_DOMAINS = ("corp.example",)


def _file_days(spark, sf):
    return declared.file_features(views.files(spark, sf))


def _mail_days(spark, sf):
    return declared.email_features(views.emails(spark, sf), OWN_DOMAINS)


@query(with_steps(f"select {U}, day, after_hours_session, weekend_session, logon_count_day, pc_count_day from session_day",
                  "session_day"))
def declared_session_features(spark, sf):
    """Sessions outside 8 to 18, weekend sessions, logons and machines per user-day."""
    return declared.session_features(views.logons(spark, sf))


@query(with_steps(f"""select c.usr as "user", c.day, cast(coalesce(c.day - max(u.day), 999) as integer) as days_since_last_usb
    from corpus c left join usb_day u on u.usr = c.usr and u.day <= c.day group by c.usr, c.day""", "corpus", "usb_day"))
def days_since_last_usb(spark, sf):
    """Days since the latest connect on every user-day."""
    days = corpus(spark, sf).select("user", "day")
    return declared.days_since_last_usb(days, connects(views.devices(spark, sf)))


@query(with_steps(f"""select {U}, day, file_count_day, unique_extensions_day, executable_access_flag,
    archive_creation_flag, off_hours_file_access from file_day""", "file_day"))
def declared_file_features(spark, sf):
    """Files, extensions, executables and archives per user-day."""
    return _file_days(spark, sf)


@query(with_steps(f"""select {U}, cast(ts as date) as day,
    count(distinct regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as domains_visited_day,
    max(case when method = 'POST' or regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), 'dropbox|wetransfer', 'i')
      then 1 else 0 end) as upload_activity_flag,
    cast(sum(case when regexp_matches(url, 'example\\.org', 'i') then 1 else 0 end) as bigint) as job_site_visits,
    max(case when hour(ts) < 7 or hour(ts) >= 19 then 1 else 0 end) as off_hours_browsing
    from v_http group by 1, 2""", "v_http"))
def declared_web_features(spark, sf):
    """Domains, uploads, job visits and off-hours browsing per user-day."""
    return declared.web_features(views.visits(spark, sf), views.CORPUS_VIEW)


@query(with_steps(f"""select {U}, day, emails_sent_day, round(attachment_size_total, 6) as attachment_size_total,
    after_hours_email, round(external_email_ratio, 6) as external_email_ratio, personal_domain_flag,
    case when s > 0 and n >= 5 then round((emails_sent_day - m) / s, 6) end as emails_sent_zscore,
    case when s > 0 and n >= 5 then 1 else 0 end as emails_sent_zscore_has_baseline
    from mail_day join (select usr, avg(emails_sent_day) as m, stddev_samp(emails_sent_day) as s, count(*) as n
      from mail_day group by usr) using (usr)""", "mail_day"))
def declared_email_features(spark, sf):
    """Mail volume, size, recipients and z-score per user-day."""
    return rounded(_mail_days(spark, sf))


@query(with_steps(f"""select {U}, day, case when max(usb) = 1 and max(file) = 1 then 1 else 0 end as usb_plus_afterhours_file from (
    select usr, ts, cast(ts as date) as day, 1 as usb, 0 as file from v_device where activity = 'Connect'
    union all select usr, ts, cast(ts as date), 0, 1 from v_file)
    where hour(ts) < 7 or hour(ts) >= 19 group by usr, day""", "v_device", "v_file"))
def usb_with_after_hours_file(spark, sf):
    """Connect and file access outside working hours on one day."""
    return declared.usb_with_after_hours_file(connects(views.devices(spark, sf)), views.files(spark, sf))


@query(with_steps(f"""select {U}, day, case when max(job_site_visits_flag) over w > 0 and max(usb_count_zscore) over w > 0
    then 1 else 0 end as job_search_plus_usb_week from corpus
    window w as (partition by usr order by day range between interval 6 days preceding and current row)""", "corpus"))
def job_search_with_usb_spike(spark, sf):
    """Job search and an unusual connect count within a week."""
    table = corpus(spark, sf).drop("job_search_plus_usb_week")
    return with_weekly_compound(table, usb="usb_count_zscore").select("user", "day", "job_search_plus_usb_week")


@query(with_steps(f"""select coalesce(f.usr, m.usr) as "user", coalesce(f.day, m.day) as day,
    case when archive_creation_flag = 1 and (external_email_ratio > 0 or personal_domain_flag = 1) then 1 else 0 end
      as external_email_plus_archive
    from file_day f full join mail_day m on f.usr = m.usr and f.day = m.day""", "file_day", "mail_day"))
def external_email_with_archive(spark, sf):
    """New archive and outgoing mail on one day."""
    return declared.external_email_with_archive(_file_days(spark, sf), _mail_days(spark, sf))


@query(with_steps(f"""select coalesce(s.usr, u.usr) as "user", coalesce(s.day, u.day) as day,
    case when pc_count_day > 1 and usb_count > 0 then 1 else 0 end as multistation_plus_usb
    from session_day s full join usb_day u on s.usr = u.usr and s.day = u.day""", "session_day", "usb_day"))
def multistation_with_usb(spark, sf):
    """Several machines and a connect on one day."""
    sessions = declared.session_features(views.logons(spark, sf))
    usb = daily_device(views.devices(spark, sf), views.HOST_VIEW).select("user", "day", "usb_count")
    return declared.multistation_with_usb(sessions, usb)
