"""Explicit schemas for every log the readers accept."""

from __future__ import annotations

from pyspark.sql import types as T

from riskloom.config import HOST_DAY_COLUMNS, UNIFIED_COLUMNS


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _L, _D, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType(),
)

LOGON_LOG = _schema(("id", _S), ("date", _S), ("user", _S), ("pc", _S), ("activity", _S))
DEVICE_LOG = LOGON_LOG
WEB_LOG = _schema(("id", _S), ("date", _S), ("user", _S), ("pc", _S), ("url", _S))
INCIDENTS = _schema(
    ("dataset", _S), ("scenario", _I), ("details", _S), ("user", _S), ("start", _S), ("end", _S),
)
_WHOLE = {"event_id", "visit_count"}
UNIFIED_LOG = _schema(*[(c, _I if c in _WHOLE else _S) for c in UNIFIED_COLUMNS])
BROWSER_EXPORT = _schema(
    ("user", _S), ("browser", _S), ("url", _S), ("title", _S), ("visit_count", _I), ("visit_us", _L),
)
EVENT_XML = """
    System struct<EventID:int, TimeCreated:struct<_SystemTime:string>>,
    EventData struct<Data:array<struct<_Name:string, _VALUE:string>>>
"""
FEATURE_CSV = _schema(*[(c, _S if c in ("date", "user", "day") else _D) for c in HOST_DAY_COLUMNS])
