from datetime import datetime

import pytest
from helpers import at, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskloom.operators import declared
from riskloom.operators.daily import connects
from riskloom.schemas import BROWSER_EXPORT, LOGON_LOG
from riskloom.sources import event_xml, logs, stores

XML = (
    "<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><EventID>{id}</EventID>"
    "<TimeCreated SystemTime='2024-01-02T03:04:05.123456Z'/></System>{body}</Event>"
)


def test_device_xml(spark):
    arrival = "<UserData><UMDFHostDeviceArrivalBegin><InstanceId>USB1</InstanceId></UMDFHostDeviceArrivalBegin></UserData>"
    request = "<UserData><u:UMDFHostDeviceRequest xmlns:u='urn:u'><u:Request><u:InstanceId>USB&amp;2</u:InstanceId></u:Request></u:UMDFHostDeviceRequest></UserData>"
    bodies = [XML.format(id=2003, body=arrival), XML.format(id=2100, body=""), "<broken", XML.format(id=2102, body=request),
              XML.format(id=2100, body=request)[:-4], "", None]
    raw = spark.createDataFrame([(b,) for b in bodies], "xml string").coalesce(1)
    got = event_xml.device_events(raw).collect()
    assert [(r["event_id"], r["device"]) for r in got] == [
        (2003, "USB1"), (2100, "N/A"), (None, "N/A"), (2102, "USB&2"), (None, "N/A"), (None, "N/A"), (None, "N/A")]
    assert got[0]["ts"] == datetime(2024, 1, 2, 3, 4, 5, 123456)


def test_security_xml(spark):
    data = '<EventData><Data Name="TargetLogonId">0x1</Data><Data Name="x">y</Data></EventData>'
    raw = spark.createDataFrame(
        [("Security", XML.format(id=4624, body=data)), ("System", XML.format(id=6005, body="")),
         ("Security", XML.format(id=6005, body=""))], "source string, xml string")
    got = event_xml.security_events(raw).collect()
    assert [(r["activity"], r["logon_id"]) for r in got] == [("LOGON", "0x1"), ("LOGON(STARTUP)", "n/a"), ("OTHER", "n/a")]


def test_browser_rules(spark):
    visits = spark.createDataFrame([
        ("a", "Chrome", "u1", None, 1, 11_644_473_600_000_000 + 1_704_067_200_000_000),
        ("a", "Chrome", "u2", "t", 1, 0), ("a", "Firefox", "u3", "t", 1, None), ("a", "Firefox", "u4", "t", 0, 5),
        ("a", "Firefox", "u5", "t", 2, 1_000_000),
    ], BROWSER_EXPORT)
    as_of = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    assert rows(logs.browser_events(visits, as_of, 30), "url", "title") == [("u1", ""), ("u3", "t")]


def test_csv_round_trip_and_missing_path(spark, tmp_path):
    table = spark.createDataFrame([("1", "01/02/2024 08:00:00", "a", "p", "Logon"), ("2", "bad", "b", "p", 'say "x"')], LOGON_LOG)
    logs.write_csv(table, str(tmp_path / "l"))
    back = logs.read_log(spark, str(tmp_path / "l"), LOGON_LOG)
    assert rows(back, "id", "ts", "activity") == [("1", datetime(2024, 1, 2, 8), "Logon"), ("2", None, 'say "x"')]
    with pytest.raises(AnalysisException):
        logs.read_log(spark, str(tmp_path / "none"), LOGON_LOG)


def test_settings_round_trip(spark, tmp_path):
    stores.save_settings(spark.createDataFrame([(0.25,)], "recommended_threshold double"), str(tmp_path / "s"))
    assert stores.load_settings(spark, str(tmp_path / "s")).first()[0] == 0.25
    assert stores.load_settings(spark, str(tmp_path / "gone")) is None


def test_months_are_folders(spark, tmp_path):
    table = spark.createDataFrame([("a", at(0).date()), ("a", at(40 * 86400).date())], "user string, day date")
    logs.write_days(table, str(tmp_path / "d"))
    assert {p.name for p in (tmp_path / "d").iterdir() if p.is_dir()} == {"month=2024-01", "month=2024-02"}


def test_declared_file_and_mail_features(spark):
    files = spark.createDataFrame(
        [("a", at(3600), "x.EXE"), ("a", at(36000), "y.zip"), ("a", at(36001), "noext"), ("a", at(36002), "z.zip")],
        "user string, ts timestamp, filename string")
    got = declared.file_features(files).first()
    assert (got["file_count_day"], got["unique_extensions_day"], got["executable_access_flag"],
            got["archive_creation_flag"], got["off_hours_file_access"]) == (4, 2, 1, 1, 1)
    mails = spark.createDataFrame(
        [("a", at(36000), ["x@corp.example", "y@gmail.com"], 1_500_000), ("a", at(36001), ["z@corp.example", "z@corp.example"], 500_000)],
        "user string, ts timestamp, recipients array<string>, size_bytes long")
    got = declared.email_features(mails, ["corp.example"]).first()
    assert (got["emails_sent_day"], got["attachment_size_total"], got["external_email_ratio"], got["personal_domain_flag"]) == (2, 2.0, 0.25, 1)


def test_days_since_last_usb(spark):
    used = spark.createDataFrame([("a", at(86400 * 2 + 50_000), "Connect"), ("b", at(0), "Disconnect")], "user string, ts timestamp, activity string")
    days = spark.createDataFrame([(u, at(86400 * d).date()) for u, d in (("a", 1), ("a", 2), ("a", 5), ("b", 3))], "user string, day date")
    got = rows(declared.days_since_last_usb(days, connects(used)), "user", "days_since_last_usb")
    assert got == [("a", 0), ("a", 3), ("a", 999), ("b", 999)]


def test_exported_files_of_events(spark, tmp_path):
    from riskloom.sources.event_xml import broken_events, device_events, read_event_files, readable_events, security_events

    def event(body, number=2003):
        return f"<Event xmlns='urn:e'><System><EventID>{number}</EventID><TimeCreated SystemTime='2024-01-02T03:04:05.000000Z'/></System>{body}</Event>"

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.xml").write_text(
        "<?xml version='1.0'?>\n<Events>\n" + event("<UserData><A xmlns='urn:d'><InstanceId>USB\\VID_1&amp;2</InstanceId></A></UserData>")
        + event("<UserData><R><S><T><d:InstanceId xmlns:d='urn:d'>deep</d:InstanceId></T></S></R></UserData>", 2100)
        + "\n\n" + event("<UserData><R/></UserData>", 2101) + event("", 2102) + "</Events>"
    )
    (tmp_path / "in" / "two.xml").write_text(event("", 1) + "<Event><System><EventID>number</EventID></System></Event><Event><Sys" + event("", 2) + "<Event><System>")
    (tmp_path / "in" / "empty.xml").write_text("")
    (tmp_path / "in" / "none.xml").write_text("<Events></Events>")
    events = read_event_files(spark, str(tmp_path / "in"))
    found = sorted((r["event_id"], r["device"], str(r["ts"]), r["file"][-7:]) for r in device_events(readable_events(events)).collect())
    when = "2024-01-02 03:04:05"
    assert found == [
        (1, "N/A", when, "two.xml"), (2, "N/A", when, "two.xml"), (2003, "USB\\VID_1&2", when, "one.xml"), (2100, "deep", when, "one.xml"),
        (2101, "N/A", when, "one.xml"), (2102, "N/A", when, "one.xml"),
    ]
    broken = broken_events(events).collect()
    assert [(r["file"][-7:], r["rows"]) for r in broken] == [("two.xml", 3)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "s.xml").write_text(
        event("<EventData><Data Name='TargetLogonId'>0x1</Data><Data Name='TargetLogonId'>0x2</Data></EventData>", 4624) + event("", 4800) + event("", 7)
    )
    session = security_events(read_event_files(spark, str(tmp_path / "log")).withColumn("source", F.lit("Security"))).collect()
    assert sorted((r["event_id"], r["activity"], r["logon_id"], r["source"]) for r in session) == [
        (7, "OTHER", "n/a", "Security"), (4624, "LOGON", "0x2", "Security"), (4800, "LOCK", "n/a", "Security")]


@pytest.mark.parametrize("events", [event_xml.device_events, event_xml.security_events])
def test_conditions_on_parsed_events_do_not_parse_again(spark, events):
    rows = [("System", "<Event><System><EventID>42</EventID><TimeCreated SystemTime='2024-01-02T03:04:05Z'/></System></Event>"),
            ("System", "<Event><System>"), ("System", None), (None, None)]
    raw = spark.createDataFrame(rows, "source string, xml string").drop(*(["source"] if events is event_xml.device_events else []))
    parsed = events(raw)
    assert parsed.count() == 4 and parsed.where("ts is not null").count() == 1
    plan = parsed.where("ts is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") + plan.count("xmltostructs(") == 1
