"""Session pairing: adjacent rows of a corpus, and the host open/close rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import (
    CORPUS, FeatureSettings, HOST, SESSION_CLOSERS, SESSION_OPENERS, STARTUP_LABEL,
)
from riskloom.functions.calendar import after_hours, minutes_between, weekend
from riskloom.operators.cells import (
    CELL, carried_from, cell_window, sliced, with_neighbour_row, without_copies,
)

_ORDER = ("ts", "id")


def _ordered():
    return [F.col(c).asc_nulls_last() for c in _ORDER]


def pair_adjacent(logons: DataFrame, settings: FeatureSettings = CORPUS) -> DataFrame:
    """Add ``session_minutes``: time to the user's next row when a Logon is followed by a Logoff.

    Rows without a time come last, so an undated Logoff still ends a pair; the length
    is then unknown and counts as 0. No machine match and no cap at midnight.
    """
    rows = sliced(logons.where(F.col("user").isNotNull()), ["user"], _ORDER)
    rows = with_neighbour_row(rows, ["user"], _ORDER, ["ts", "id", "activity"], "next")
    window = cell_window(["user"], _ordered())
    paired = (F.col("activity") == "Logon") & (F.lead("activity").over(window) == "Logoff")
    minutes = F.when(paired, minutes_between(F.col("ts"), F.lead("ts").over(window)))
    rows = rows.withColumn("session_minutes", F.coalesce(minutes, F.lit(0.0)))
    return without_copies(rows).drop(CELL)


def host_sessions(events: DataFrame, settings: FeatureSettings = HOST) -> DataFrame:
    """One row per session opened within a user-day: open time, activity and close time.

    The first opener after a closer (or after midnight) opens the session, the next
    closer ends it. Openers and closers alternate once repeats are dropped, so each
    kept opener's session ends at the kept row that follows it.
    """
    keys = ["user", "day"]
    kind = (
        F.when(F.col("activity").isin(*SESSION_OPENERS), F.lit("open"))
        .when(F.col("activity").isin(*SESSION_CLOSERS), F.lit("close"))
    )
    rows = (
        events.where(F.col("user").isNotNull() & F.col("ts").isNotNull())
        .select("user", "ts", "id", "activity", kind.alias("kind"))
        .where(F.col("kind").isNotNull())
        .withColumn("day", F.to_date("ts"))
    )
    rows = sliced(rows, keys, _ORDER)
    window = cell_window(keys, _ordered())
    later = window.rowsBetween(1, Window.unboundedFollowing)
    before = carried_from(rows, keys, F.max_by("kind", F.struct(*_ORDER)), "__kind_before", "previous")
    turns = (
        rows.join(before, [*keys, CELL], "left")
        .withColumn("__last", F.coalesce(F.lag("kind").over(window), F.col("__kind_before")))
        .where(F.col("__last").isNull() | (F.col("__last") != F.col("kind"))).drop("__last", "__kind_before")
    )
    after = carried_from(turns, keys, F.min("ts"), "__ts_after", "next")
    closing = F.coalesce(F.first("ts").over(later), F.col("__ts_after"))
    turns = turns.join(after, [*keys, CELL], "left").withColumn("close_ts", closing)
    return turns.where(F.col("kind") == "open").select(
        "user", "day", "id", F.col("ts").alias("open_ts"), "activity", "close_ts"
    )


def host_session_days(events: DataFrame, settings: FeatureSettings = HOST) -> DataFrame:
    """Host session totals per user-day; every user-day with an event has a row.

    A session still open at the day's end runs to midnight when the day saw a
    shutdown; otherwise, and on days without a startup, the total is unknown (null).
    After-hours and weekend are judged at the open time of sessions that ended.
    """
    shutdown = F.col("activity").isin(*[a for a in SESSION_CLOSERS if "shutdown" in a.lower()])
    days = (
        events.where(F.col("user").isNotNull() & F.col("ts").isNotNull())
        .groupBy("user", F.to_date("ts").alias("day"))
        .agg(
            F.max(F.coalesce(F.col("activity") == STARTUP_LABEL, F.lit(False))).alias("has_startup"),
            F.max(F.coalesce(shutdown, F.lit(False))).alias("has_shutdown"),
        )
    )
    calendar = settings.calendar
    midnight = F.date_add("day", 1).cast("timestamp")
    closed = F.col("close_ts").isNotNull()
    open_flags = {
        "after": after_hours(F.col("open_ts"), calendar),
        "weekend": weekend(F.col("open_ts"), calendar.weekend_days),
    }
    sessions = (
        host_sessions(events, settings)
        .withColumns(open_flags)
        .groupBy("user", "day")
        .agg(
            F.sum(F.when(closed, minutes_between(F.col("open_ts"), F.col("close_ts")))).alias("closed_minutes"),
            F.sum(F.when(closed, F.col("after"))).alias("closed_after"),
            F.max(F.when(closed, F.col("weekend"))).alias("closed_weekend"),
            F.count_if(F.col("activity") == STARTUP_LABEL).alias("logon_count"),
            F.count_if(~closed).alias("open_count"),
            F.sum(F.when(~closed, minutes_between(F.col("open_ts"), midnight))).alias("open_minutes"),
            F.sum(F.when(~closed, F.col("after"))).alias("open_after"),
            F.max(F.when(~closed, F.col("weekend"))).alias("open_weekend"),
        )
    )
    zero = F.lit(0)
    to_midnight = F.coalesce(F.col("open_count") > 0, F.lit(False)) & F.col("has_shutdown")
    unknown = F.coalesce(F.col("open_count") > 0, F.lit(False)) & ~F.col("has_shutdown")

    def with_open(name: str):
        extra = F.when(to_midnight, F.coalesce(F.col(f"open_{name}"), zero)).otherwise(zero)
        return F.coalesce(F.col(f"closed_{name}"), zero), extra

    minutes, open_minutes = with_open("minutes")
    after, open_after = with_open("after")
    week, open_week = with_open("weekend")
    return days.join(sessions, ["user", "day"], "left").select(
        "user", "day",
        F.when(F.col("has_startup") & ~unknown, (minutes + open_minutes).cast("double"))
        .alias("total_active_minutes_day"),
        (after + open_after).cast("long").alias("after_hours_session_count"),
        F.greatest(week, open_week).cast("int").alias("weekend_session_flag"),
        F.coalesce("logon_count", zero).cast("long").alias("logon_count"),
    )
