"""Readers and writers: data goes out and comes back."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.config import UNIFIED_COLUMNS
from riskloom.operators import scoring
from riskloom.operators.ordering import global_rank
from riskloom.plans.host import host_days
from riskloom.plans.materialise import new_path
from riskloom.registry import views
from riskloom.registry.core import query, rounded
from riskloom.registry.host import _host_sql
from riskloom.registry.scoring import fused
from riskloom.registry.sql_views import with_steps
from riskloom.schemas import DEVICE_LOG, LOGON_LOG
from riskloom.sources import event_xml, logs, stores

U = 'usr as "user"'


@query(with_steps(f"""select id, {U}, pc, activity, date_trunc('second', ts) as ts from v_logon
    union all select id, {U}, pc, activity, date_trunc('second', ts) from v_device""", "v_logon", "v_device"))
def csv_logs(spark, sf):
    """Two logs written as CSV and read with their schema."""
    parts = []
    for name, view, schema in (("logon", views.logons, LOGON_LOG), ("device", views.devices, DEVICE_LOG)):
        path = new_path(spark, name)
        written = view(spark, sf).select(
            F.col("id").cast("string"), F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("date"),
            "user", "pc", "activity",
        )
        logs.write_csv(written, path)
        parts.append(logs.read_log(spark, path, schema))
    return parts[0].unionByName(parts[1]).select(
        F.col("id").cast("long"), "user", "pc", "activity", F.col("ts").cast("timestamp_ntz").alias("ts")
    )


@query(_host_sql("host_all_days").replace("strftime(day, '%m/%d/%Y') as day", "day"))
def csv_features(spark, sf):
    """The host user-day table written as CSV and read with parsed days."""
    path = new_path(spark, "features")
    logs.write_csv(host_days(views.categorised(views.host_events(spark, sf)), views.HOST_VIEW), path)
    table = logs.read_features(spark, path)
    whole = [c for c in table.columns if c.endswith(("_flag", "_baseline", "_week"))]
    counts = ["after_hours_session_count", "usb_count", "usb_device_diversity_monthly"]
    return rounded(table.withColumns(
        {c: F.col(c).cast("int") for c in whole} | {c: F.col(c).cast("long") for c in counts}
    ))


@query(with_steps(f"""select {U}, source, event_id, activity, device, url, cast(ts as date) as day,
    epoch_us(ts) as unix_us from v_host""", "v_host"))
def csv_unified_log(spark, sf):
    """The unified host log with offset times, written and read."""
    path = new_path(spark, "unified")
    logs.write_csv(logs.to_unified(views.host_events(spark, sf)), path, UNIFIED_COLUMNS)
    log = logs.read_unified(spark, path)
    return log.select(
        "user", "source", "event_id", "activity", "device", "url", F.to_date("ts").alias("day"),
        F.unix_micros("ts").alias("unix_us"),
    )


@query(with_steps(f"""select id, {U}, event_id, epoch_us(ts) as unix_us,
    case when k % 4 <> 3 then device else 'N/A' end as device from v_host where source = 'UMDF'""", "v_host"))
def device_event_xml(spark, sf):
    """Device events parsed from XML text."""
    raw = views.event_xml(spark, sf).where(F.col("source") == "UMDF").drop("source")
    return event_xml.device_events(raw).select(
        "id", "user", "event_id", F.unix_micros("ts").alias("unix_us"), "device"
    )


@query(with_steps(f"""select id, {U}, coalesce(event_id, 9999) as event_id, epoch_us(ts) as unix_us,
    coalesce(activity, 'OTHER') as activity, case when k % 5 <> 0 then '0x' || k else 'n/a' end as logon_id
    from v_host where source in ('Security', 'System')""", "v_host"))
def security_event_xml(spark, sf):
    """Security and system events parsed from XML text, with activity labels."""
    raw = views.event_xml(spark, sf).where(F.col("source").isin("Security", "System"))
    return event_xml.security_events(raw).select(
        "id", "user", "event_id", F.unix_micros("ts").alias("unix_us"), "activity", "logon_id"
    )


def _event_files(spark, sf, *sources):
    """Exported files of a log: the XML text of its events, many to a file."""
    path = new_path(spark, "event-files")
    views.event_xml(spark, sf).where(F.col("source").isin(*sources)).select("xml").write.text(path)
    return event_xml.readable_events(event_xml.read_event_files(spark, path))


@query(with_steps("""select event_id, epoch_us(ts) as unix_us,
    case when k % 4 <> 3 then device else 'N/A' end as device from v_host where source = 'UMDF'""", "v_host"))
def device_event_files(spark, sf):
    """Device events read from exported XML files."""
    events = event_xml.device_events(_event_files(spark, sf, "UMDF"))
    return events.select("event_id", F.unix_micros("ts").alias("unix_us"), "device")


@query(with_steps("""select source, coalesce(event_id, 9999) as event_id, epoch_us(ts) as unix_us,
    coalesce(activity, 'OTHER') as activity, case when k % 5 <> 0 then '0x' || k else 'n/a' end as logon_id
    from v_host where source in ('Security', 'System')""", "v_host"))
def security_event_files(spark, sf):
    """Security and system events read from the exported files of each log."""
    logs_of = [_event_files(spark, sf, log).withColumn("source", F.lit(log)) for log in ("Security", "System")]
    return event_xml.security_events(logs_of[0].unionByName(logs_of[1])).select(
        "source", "event_id", F.unix_micros("ts").alias("unix_us"), "activity", "logon_id"
    )


@query(with_steps(f"""select b.id, {U.replace('usr', 'b.usr')}, browser, url, coalesce(title, '') as title,
    visit_count, case when visit_us <> 0 then epoch_us(e.ts) end as unix_us
    from v_browser b join ev e on e.id = b.id
    where case when browser = 'Firefox' then visit_count > 0 else coalesce(visit_us, 0) > 0 end
      and (coalesce(visit_us, 0) = 0 or e.ts >= timestamp '2024-01-31 00:00:00' - interval 12 day)""",
                  "v_browser", "ev"))
def browser_history(spark, sf):
    """Exported visits of the last days before a given time."""
    as_of = F.to_timestamp(F.lit(views.AS_OF))
    return logs.browser_events(views.browser_export(spark, sf), as_of, 12).select(
        "id", "user", "browser", "url", "title", "visit_count", F.unix_micros("ts").alias("unix_us")
    )


@query(with_steps("""select rn, id from (select id, row_number() over (order by ts, id) as rn from v_host)""", "v_host"))
def chronological_log(spark, sf):
    """The host log in time order with its position."""
    events = views.host_events(spark, sf).select("id", "ts")
    return global_rank(events, [F.col("ts"), F.col("id")], "rn").select("rn", "id")


@query(with_steps("""select round(quantile_cont(combined_risk_score, 0.98), 6) as recommended_threshold,
    count(*) as training_rows from fused""", "fused"))
def saved_thresholds(spark, sf):
    """Thresholds written as JSON and read back."""
    path = new_path(spark, "thresholds")
    stores.save_settings(scoring.thresholds(fused(spark, sf), views.VERSION), path)
    saved = stores.load_settings(spark, path)
    return rounded(saved.select("recommended_threshold", "training_rows"))
