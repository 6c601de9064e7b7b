"""SQL twins of the views and the shared steps of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

import re

from riskloom.registry.core import MINUTES

_EVENTS = """select event_id as id, 'u' || cast(user_id as varchar) as usr, ts, event_type, value,
  cast(json_extract_string(props, '$.k') as integer) as k from events"""

_SESSION_KIND = """case when activity in ('LOGON(STARTUP)', 'UNLOCK', 'WAKE') then 'open'
  when activity in ('LOGOFF(shutdown)', 'LOCK', 'SLEEP') then 'close' end"""


def _after(ts: str) -> str:
    return f"case when hour({ts}) < 7 or hour({ts}) >= 19 then 1 else 0 end"


def _week(ts: str) -> str:
    return f"case when isodow({ts}) - 1 in (4, 5) then 1 else 0 end"


def _dedup(source: str, keys: str, drop: str) -> str:
    """Ids kept by a last-kept rule: one recursion over the numbered rows of each key."""
    return f"""numbered_{source} as (
  select *, row_number() over (partition by {keys} order by ts, id) as rn from {source}),
walk_{source} as (
  select {keys}, rn, id, ts as last_ts, kind as last_kind, true as kept from numbered_{source} where rn = 1
  union all
  select n.{', n.'.join(k.strip() for k in keys.split(','))}, n.rn, n.id,
    case when {drop} then w.last_ts else n.ts end,
    case when {drop} then w.last_kind else n.kind end,
    not ({drop})
  from walk_{source} w join numbered_{source} n
    on {' and '.join(f'n.{k.strip()} = w.{k.strip()}' for k in keys.split(','))} and n.rn = w.rn + 1),
kept_{source} as (select id from walk_{source} where kept)"""


def _zscore(value: str, name: str, days: int = 5) -> str:
    has = f"(stddev_samp({value}) over (partition by usr) > 0 and count({value}) over (partition by usr) >= {days})"
    return f"""case when {has} then ({value} - avg({value}) over (partition by usr))
    / stddev_samp({value}) over (partition by usr) end as {name},
  case when coalesce({has}, false) then 1 else 0 end as {name}_has_baseline"""


# name -> (body, names it needs). A body that defines several names lists them itself.
STEPS: dict[str, tuple[str, tuple[str, ...]]] = {
    "ev": (_EVENTS, ()),
    "v_logon": ("""select id, usr, ts, 'pc' || (k % 7) as pc,
  case event_type when 'signup' then 'Logon' else 'Logoff' end as activity
  from ev where event_type in ('signup', 'error')""", ("ev",)),
    "v_device": ("""select id, usr, ts, 'pc' || k as pc,
  case event_type when 'purchase' then 'Connect' else 'Disconnect' end as activity
  from ev where event_type in ('purchase', 'view')""", ("ev",)),
    "v_http": ("""select e.id, e.usr, e.ts, p.url, case when e.k % 4 = 0 then 'POST' else 'GET' end as method
  from ev e join pages p on p.page_id = e.id % (select count(*) from pages)
  where e.event_type = 'click'""", ("ev",)),
    "v_host": ("""select id, usr, ts,
  case when event_type = 'purchase' then 'UMDF' when event_type = 'click' and k >= 50 then 'Browser'
    when event_type = 'click' then 'Security' else 'System' end as source,
  case when event_type = 'purchase' and k % 2 = 0 then 2003 when event_type = 'purchase' then 2100
    when event_type = 'signup' then 6005 when event_type = 'view' then 107
    when event_type = 'error' then 1074 when event_type = 'click' and k < 25 then 4624
    when event_type = 'click' and k < 50 then 4800 end as event_id,
  case when event_type = 'signup' then 'LOGON(STARTUP)' when event_type = 'view' then 'WAKE'
    when event_type = 'error' then 'LOGOFF(shutdown)' when event_type = 'click' and k < 25 then 'LOGON'
    when event_type = 'click' and k < 50 then 'LOCK' end as activity,
  case when event_type <> 'purchase' then null when k % 6 < 2 then 'USB_VID_0'
    when k % 6 < 4 then 'USB_VID_1' else 'PCI_0' end as device,
  case when event_type = 'click' and k >= 50 then 'https://' ||
    case when k % 3 = 0 then 'career' else 'news' end || '.example.com/' || k end as url,
  case when event_type = 'purchase' then case when k % 2 = 0 then 'CONNECT' else 'DISCONNECT' end end as category,
  k from ev""", ("ev",)),
    "v_insiders": ("""select usr, case when views >= clicks then '4.2' else '5.2' end as dataset,
  cast(clicks % 3 + 1 as integer) as scenario, start_day, start_day + 6 as end_day from (
    select usr, max(value) as top, cast(arg_max(ts, {'v': value, 'i': id}) as date) as start_day,
      count(*) filter (event_type = 'view') as views, count(*) filter (event_type = 'click') as clicks
    from ev group by usr) where top > 220""", ("ev",)),
    "v_scores": ("""select id, usr, cast(ts as date) as day, -value / 97 as iso_score,
  -value * value / 997 as lof_score, case when value < 1 then value else 1 / value end as supervised_score,
  case when value > 100 then -1 else 1 end as iso_prediction,
  case when value > 150 or value < 1 then -1 else 1 end as lof_prediction,
  k % 2 as is_synthetic, case when k % 5 = 0 then 1 else 0 end as job_site_visits_flag,
  (k - 50) / 17 as usb_count_zscore, case when value > 120 then 1 else 0 end as insider_label
  from ev""", ("ev",)),
    "v_file": ("""select id, usr, ts, 'f' || k || case when k % 9 = 0 then '.exe' when k % 9 = 1 then '.zip'
  when k % 2 = 0 then '.pdf' else '.docx' end as filename from ev where event_type = 'view'""", ("ev",)),
    "v_email": ("""select id, usr, ts, list_filter([case when k % 5 = 0 then 'a@gmail.com'
    when k % 5 = 1 then 'b@partner.example' else 'c@corp.example' end,
    case when k % 3 = 0 then 'd@corp.example' end], lambda x: x is not null) as recipients,
  cast(round(value * 100) as bigint) * 10 as size_bytes from ev where event_type = 'click'""", ("ev",)),
    "v_browser": ("""select id, usr, case when k % 2 = 0 then 'Firefox' else 'Chrome' end as browser,
  'https://site.example.com/' || k as url, case when k % 3 <> 0 then 'Page ' || k end as title,
  k % 4 as visit_count, case when k % 10 = 0 then null when k % 10 = 1 then 0
    when k % 2 = 0 then epoch_us(ts) else epoch_us(ts) + 11644473600000000 end as visit_us
  from ev where event_type = 'click'""", ("ev",)),

    # corpus user-days
    "logon_paired": (f"""select *, case when activity = 'Logon'
    and lead(activity) over (partition by usr order by ts, id) = 'Logoff'
    then (epoch_us(lead(ts) over (partition by usr order by ts, id)) - epoch_us(ts)) / 60000000.0
    else 0 end as minutes, cast(ts - interval 1 day as date) as day,
  {_after('ts')} as after_hours, {_week("(ts - interval 1 day)")} as weekend from v_logon""", ("v_logon",)),
    "logon_day": ("""select usr, day, sum(minutes) as total_active_minutes_day,
  cast(sum(after_hours) as bigint) as after_hours_session_count, max(weekend) as weekend_session_flag,
  count(*) filter (activity = 'Logon') as logon_count from logon_paired group by usr, day""", ("logon_paired",)),
    "logon_z": (f"select *, {_zscore('logon_count', 'logon_count_zscore')} from logon_day", ("logon_day",)),
    "device_row": (f"""select usr, cast(ts - interval 1 day as date) as day,
  date_trunc('month', ts - interval 1 day) as month, pc, {_after('ts')} as after_hours,
  {_week("(ts - interval 1 day)")} as weekend from v_device where activity = 'Connect'""", ("v_device",)),
    "device_month": ("""select usr, month, count(distinct pc) as usb_device_diversity_monthly
  from device_row group by usr, month""", ("device_row",)),
    "device_day": ("""select d.*, m.usb_device_diversity_monthly from (
    select usr, day, count(*) as usb_count, max(after_hours) as usb_after_hours_flag,
      max(weekend) as usb_on_weekend_flag from device_row group by usr, day) d
  left join device_month m on m.usr = d.usr and m.month = date_trunc('month', d.day)""",
                   ("device_row", "device_month")),
    "device_z": (f"select *, {_zscore('usb_count', 'usb_count_zscore')} from device_day", ("device_day",)),
    "web_day": ("""select usr, cast(ts - interval 1 day as date) as day,
  max(case when regexp_matches(url, 'example\\.org', 'i') then 1 else 0 end) as job_site_visits_flag
  from v_http group by 1, 2""", ("v_http",)),
    "corpus_joined": ("""select coalesce(a.usr, w.usr) as usr, coalesce(a.day, w.day) as day, a.* exclude (usr, day),
  w.job_site_visits_flag from (
    select coalesce(l.usr, d.usr) as usr, coalesce(l.day, d.day) as day, l.* exclude (usr, day), d.* exclude (usr, day)
    from logon_z l full join device_z d on l.usr = d.usr and l.day = d.day) a
  full join web_day w on a.usr = w.usr and a.day = w.day""", ("logon_z", "device_z", "web_day")),
    "corpus": ("""select *, case when max(job_site_visits_flag) over w > 0 and max(usb_count_zscore) over w > 0
    then 1 else 0 end as job_search_plus_usb_week from (
  select usr, day, coalesce(total_active_minutes_day, 0) as total_active_minutes_day,
    coalesce(after_hours_session_count, 0) as after_hours_session_count,
    coalesce(weekend_session_flag, 0) as weekend_session_flag, logon_count_zscore,
    logon_count_zscore_has_baseline, coalesce(usb_count, 0) as usb_count,
    coalesce(usb_after_hours_flag, 0) as usb_after_hours_flag,
    coalesce(usb_on_weekend_flag, 0) as usb_on_weekend_flag,
    coalesce(usb_device_diversity_monthly, 0) as usb_device_diversity_monthly, usb_count_zscore,
    usb_count_zscore_has_baseline, coalesce(job_site_visits_flag, 0) as job_site_visits_flag
  from corpus_joined)
  window w as (partition by usr order by day range between interval 6 days preceding and current row)""",
               ("corpus_joined",)),

    # host cleaning
    "startup": ("select id, usr, ts, 1 as kind from v_host where activity = 'LOGON(STARTUP)'", ("v_host",)),
    "kept_startup": (_dedup("startup", "usr", "n.ts - w.last_ts <= interval 1 hour"), ("startup",)),
    "boot_kept": ("""select h.* exclude (last_start) from (select *,
    max(case when activity = 'LOGON(STARTUP)' then ts end) over (partition by usr order by ts, id) as last_start
    from v_host where activity is distinct from 'LOGON(STARTUP)' or id in (select id from kept_startup)) h
  where not (coalesce(activity, '') = 'LOGON' and coalesce(ts - last_start <= interval 1 hour, false))""",
                  ("v_host", "kept_startup")),
    "usb": ("""select id, usr, device, ts, category as kind from boot_kept
  where source = 'UMDF' and regexp_matches(device, '^USB_VID_', 'i')""", ("boot_kept",)),
    "usb_raw": ("select id, usr, device, ts, category as kind from v_host where source = 'UMDF'", ("v_host",)),
    "kept_usb": (_dedup("usb", "usr, device", """(n.kind = w.last_kind and n.ts - w.last_ts <= interval 24 hours)
      or (w.last_kind = 'CONNECT' and n.kind = 'DISCONNECT' and n.ts - w.last_ts < interval 16 hours)"""), ("usb",)),
    "kept_usb_raw": (_dedup("usb_raw", "usr, device", """(n.kind = w.last_kind and n.ts - w.last_ts <= interval 24 hours)
      or (w.last_kind = 'CONNECT' and n.kind = 'DISCONNECT' and n.ts - w.last_ts < interval 16 hours)"""), ("usb_raw",)),
    "host_all": ("select * from v_host", ("v_host",)),
    "host_clean": ("""select * from boot_kept where source <> 'UMDF' or id in (select id from kept_usb)""",
                   ("boot_kept", "kept_usb")),
}


def _host_days(events: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Host user-days of an event step; step names carry its name."""
    e = events
    return {
        f"{e}_turn": (f"""select * exclude (last_kind), lead(ts) over (partition by usr, day order by ts, id) as close_ts from (
    select *, lag(kind) over (partition by usr, day order by ts, id) as last_kind from (
      select usr, id, ts, cast(ts as date) as day, activity, {_SESSION_KIND} as kind from {e}
      where source in ('Security', 'System')) where kind is not null)
  where last_kind is distinct from kind""", (e,)),
        f"{e}_session": (f"""select usr, day, id, ts as open_ts, activity, close_ts from {e}_turn where kind = 'open'""",
                         (f"{e}_turn",)),
        f"{e}_logon": (f"""select usr, day,
    case when has_startup and not (open_n > 0 and not has_shutdown) then minutes end as total_active_minutes_day,
    after_hours as after_hours_session_count, weekend as weekend_session_flag, logon_count from (
  select d.usr, d.day, d.has_startup, d.has_shutdown, coalesce(s.open_n, 0) as open_n,
    coalesce(s.minutes, 0) + case when d.has_shutdown then coalesce(s.open_minutes, 0) else 0 end as minutes,
    cast(coalesce(s.after_n, 0) + case when d.has_shutdown then coalesce(s.open_after, 0) else 0 end as bigint) as after_hours,
    cast(greatest(coalesce(s.week, 0), case when d.has_shutdown then coalesce(s.open_week, 0) else 0 end) as integer) as weekend,
    coalesce(s.logon_count, 0) as logon_count
  from (select usr, cast(ts as date) as day, bool_or(coalesce(activity, '') = 'LOGON(STARTUP)') as has_startup,
      bool_or(coalesce(activity, '') = 'LOGOFF(shutdown)') as has_shutdown
    from {e} where source in ('Security', 'System') group by 1, 2) d
  left join (select usr, day,
      sum((epoch_us(close_ts) - epoch_us(open_ts)) / 60000000.0) as minutes,
      sum({_after('open_ts')}) filter (close_ts is not null) as after_n,
      max({_week('open_ts')}) filter (close_ts is not null) as week,
      count(*) filter (activity = 'LOGON(STARTUP)') as logon_count,
      count(*) filter (close_ts is null) as open_n,
      sum((epoch_us(cast(day + 1 as timestamp)) - epoch_us(open_ts)) / 60000000.0) filter (close_ts is null) as open_minutes,
      sum({_after('open_ts')}) filter (close_ts is null) as open_after,
      max({_week('open_ts')}) filter (close_ts is null) as open_week
    from {e}_session group by 1, 2) s using (usr, day))""", (e, f"{e}_session")),
        f"{e}_logon_z": (f"select *, {_zscore('logon_count', 'logon_count_zscore')} from {e}_logon", (f"{e}_logon",)),
        f"{e}_usb": (f"""select d.*, m.n as usb_device_diversity_monthly from (
    select usr, cast(ts as date) as day, count(device) as usb_count, max({_after('ts')}) as usb_after_hours_flag,
      max({_week('ts')}) as usb_on_weekend_flag from {e}
    where source = 'UMDF' and category = 'CONNECT' group by 1, 2) d
  join (select usr, date_trunc('month', ts) as month, count(distinct device) as n from {e}
    where source = 'UMDF' and category = 'CONNECT' group by 1, 2) m
    on m.usr = d.usr and m.month = date_trunc('month', d.day)""", (e,)),
        f"{e}_usb_z": (f"select *, {_zscore('usb_count', 'usb_count_zscore')} from {e}_usb", (f"{e}_usb",)),
        f"{e}_web": (f"""select usr, cast(ts as date) as day,
    max(case when regexp_matches(url, 'indeed|linkedin|monster|career|glassdoor|job', 'i') then 1 else 0 end)
      as job_site_visits_flag from {e} where source = 'Browser' group by 1, 2""", (e,)),
        f"{e}_days": (f"""select *, case when max(job_site_visits_flag) over w > 0 and max(usb_count) over w > 0
    then 1 else 0 end as job_search_plus_usb_week from (
  select coalesce(a.usr, w.usr) as usr, coalesce(a.day, w.day) as day, total_active_minutes_day,
    coalesce(after_hours_session_count, 0) as after_hours_session_count,
    coalesce(weekend_session_flag, 0) as weekend_session_flag, logon_count_zscore, logon_count_zscore_has_baseline,
    coalesce(usb_count, 0) as usb_count, coalesce(usb_after_hours_flag, 0) as usb_after_hours_flag,
    coalesce(usb_on_weekend_flag, 0) as usb_on_weekend_flag,
    coalesce(usb_device_diversity_monthly, 0) as usb_device_diversity_monthly, usb_count_zscore,
    usb_count_zscore_has_baseline, coalesce(w.job_site_visits_flag, 0) as job_site_visits_flag
  from (select coalesce(l.usr, u.usr) as usr, coalesce(l.day, u.day) as day, l.* exclude (usr, day),
      u.* exclude (usr, day) from {e}_logon_z l full join {e}_usb_z u on l.usr = u.usr and l.day = u.day) a
  full join {e}_web w on a.usr = w.usr and a.day = w.day
  where coalesce(after_hours_session_count, 0) > 0 or logon_count_zscore is not null
    or coalesce(usb_count, 0) > 0 or coalesce(w.job_site_visits_flag, 0) > 0)
  window w as (partition by usr order by day range between interval 6 days preceding and current row)""",
                    (f"{e}_logon_z", f"{e}_usb_z", f"{e}_web")),
    }


STEPS.update(_host_days("host_all"))
STEPS.update(_host_days("host_clean"))

# labels, scores
STEPS.update({
    "incident_day": ("""select distinct usr, cast(unnest(generate_series(start_day, end_day, interval 1 day)) as date) as day
  from v_insiders where dataset = '4.2' and start_day <= end_day""", ("v_insiders",)),
    "labelled": ("""select c.*, case when i.usr is null then 0 else 1 end as insider_label
  from corpus c left join incident_day i on i.usr = c.usr and i.day = c.day""", ("corpus", "incident_day")),
    "insider_user": ("select usr, max(insider_label) as is_insider from labelled group by usr", ("labelled",)),
    "score_range": ("""select min(iso_score) as iso_lo, max(iso_score) as iso_hi, min(lof_score) as lof_lo,
  max(lof_score) as lof_hi from v_scores""", ("v_scores",)),
    "fused": ("""select *, least(greatest(0.7 * supervised_score + 0.3 * unsupervised_score, 0), 1) as combined_risk_score from (
  select *, least(greatest((iso_score_norm + lof_score_norm) / 2
    * case when flagged_by_both = 1 then 1.15 else 1 end, 0), 1) as unsupervised_score from (
  select s.*, 1 - (iso_score - iso_lo) / (iso_hi - iso_lo) as iso_score_norm,
    1 - (lof_score - lof_lo) / (lof_hi - lof_lo) as lof_score_norm,
    case when iso_prediction = -1 and lof_prediction = -1 then 1 else 0 end as flagged_by_both
  from v_scores s, score_range))""", ("v_scores", "score_range")),
    "deployed": ("""select *, case when combined_risk_score >= 0.3793 then 1 else 0 end as above_threshold from (
  select *, unsupervised_score as combined_risk_score from (
  select *, (iso_score_norm + lof_score_norm) / 2 as unsupervised_score from (
  select s.*, least(greatest(1 - (iso_score + 3) / (3 + 1e-9), 0), 1) as iso_score_norm,
    least(greatest(1 - (lof_score - lof_lo) / (lof_hi - lof_lo + 1e-9), 0), 1) as lof_score_norm,
    case when iso_prediction = -1 and lof_prediction = -1 then 1 else 0 end as flagged_by_both
  from v_scores s, score_range)))""", ("v_scores", "score_range")),
    "deploy_user": ("""select usr, is_synthetic, cast(sum(above_threshold) as bigint) as days_above_threshold,
  avg(combined_risk_score) as final_risk_score, max(supervised_score) as supervised_max,
  avg(supervised_score) as supervised_mean, max(unsupervised_score) as unsupervised_max,
  avg(unsupervised_score) as unsupervised_mean, avg(iso_score_norm) as iso_score_norm_mean,
  avg(lof_score_norm) as lof_score_norm_mean, count(*) filter (iso_prediction = -1) as days_flagged_iso,
  count(*) filter (lof_prediction = -1) as days_flagged_lof,
  cast(sum(flagged_by_both) as bigint) as days_flagged_both, count(combined_risk_score) as total_days
  from deployed group by usr, is_synthetic""", ("deployed",)),
    "deploy_peak": ("""select usr, day as peak_date from (select usr, day,
    row_number() over (partition by usr order by combined_risk_score desc, day) as rn from deployed) where rn = 1""",
                    ("deployed",)),
    "deploy_report": ("""select row_number() over (order by unsupervised_mean desc, usr, is_synthetic) as rank, u.*,
  0.7 * (final_risk_score - min(final_risk_score) over ()) / (max(final_risk_score) over () - min(final_risk_score) over () + 1e-9)
  + 0.3 * (days_above_threshold - min(days_above_threshold) over ())
    / (max(days_above_threshold) over () - min(days_above_threshold) over () + 1e-9) as composite_rank_score,
  p.peak_date from deploy_user u join deploy_peak p using (usr)""", ("deploy_user", "deploy_peak")),

    # declared features
    "session_day": ("""select usr, cast(ts as date) as day,
  max(case when hour(ts) < 8 or hour(ts) >= 18 then 1 else 0 end) as after_hours_session,
  max(case when isodow(ts) in (6, 7) then 1 else 0 end) as weekend_session,
  count(*) filter (activity = 'Logon') as logon_count_day, count(distinct pc) as pc_count_day
  from v_logon group by 1, 2""", ("v_logon",)),
    "usb_day": ("""select usr, cast(ts as date) as day, count(*) as usb_count from v_device
  where activity = 'Connect' group by 1, 2""", ("v_device",)),
    "file_day": (f"""select usr, cast(ts as date) as day, count(*) as file_count_day,
  count(distinct lower(regexp_extract(filename, '\\.([^.]+)$', 1))) as unique_extensions_day,
  max(case when regexp_matches(filename, '\\.(exe|bat|ps1)$', 'i') then 1 else 0 end) as executable_access_flag,
  max(case when regexp_matches(filename, '\\.(zip|rar)$', 'i') then 1 else 0 end) as archive_creation_flag,
  max({_after('ts')}) as off_hours_file_access from v_file group by 1, 2""", ("v_file",)),
    "mail_day": (f"""select m.*, r.external_email_ratio, r.personal_domain_flag from (
    select usr, cast(ts as date) as day, count(*) as emails_sent_day, sum(size_bytes) / 1000000.0 as attachment_size_total,
      max({_after('ts')}) as after_hours_email from v_email group by 1, 2) m
  join (select usr, day, avg(case when d = 'corp.example' then 0.0 else 1.0 end) as external_email_ratio,
      max(case when d in ('gmail.com', 'yahoo.com', 'hotmail.com') then 1 else 0 end) as personal_domain_flag
    from (select usr, cast(ts as date) as day, lower(split_part(unnest(recipients), '@', 2)) as d from v_email)
    group by 1, 2) r using (usr, day)""", ("v_email",)),
})


def with_steps(select: str, *needs: str) -> str:
    """A statement whose CTEs are the named steps and all they need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in STEPS[name][1]:
            visit(need)
        order.append(name)

    for need in needs:
        visit(need)
    parts = []
    for name in order:
        body = STEPS[name][0]
        # A recursion brings its own named parts.
        parts.append(body if re.match(r"numbered_", body) else f"{name} as ({body})")
    return "with recursive " + ",\n".join(parts) + "\n" + select


def rounded(columns: str, places: int = 6) -> str:
    """``round(c, 6) as c`` for each named column."""
    return ", ".join(f"round({c}, {MINUTES.get(c, places)}) as {c}" for c in columns.split())
