import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from helpers import at, rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.config import CleaningSettings
from riskloom.operators.cleaning import (
    clean_host_log, keep_spaced, startup_dedup, usb_dedup, usb_only, within_lookback, without_boot_logons,
)
from riskloom.operators.spaced import CONNECT, OTHER, Rule, kept_rows, slice_map

SCHEMA = "id long, user string, ts timestamp, source string, event_id int, activity string, device string"


def events(spark, entries):
    return spark.createDataFrame([
        (i, e.get("user", "a"), None if e["t"] is None else at(e["t"]), e.get("source", "UMDF"),
         e.get("event_id", 2003), e.get("activity"), e.get("device", "USB\\VID_1"))
        for i, e in enumerate(entries)
    ], SCHEMA)


def plain_walk(entries, duplicate, bounce):
    """Ids kept by the rule, row by row; entries are (id, key, seconds, connect)."""
    last, kept = {}, []
    for i, key, t, connect in sorted(entries, key=lambda e: (e[2], e[0])):
        if key in last:
            before, was = last[key]
            gap = round(t - before, 6)
            if (connect == was and gap <= duplicate) or (was and not connect and gap < bounce):
                continue
        last[key] = (t, connect)
        kept.append(i)
    return sorted(kept)


def test_repeats_are_measured_from_the_last_kept_row(spark):
    kept = usb_dedup(events(spark, [{"t": 0}, {"t": 1.0}, {"t": 2.0}]))
    assert rows(kept, "id", "category") == [(0, "CONNECT"), (2, "CONNECT")]


def test_bounce_limit_is_strict(spark):
    kept = usb_dedup(events(spark, [{"t": 0}, {"t": 0.9, "event_id": 2100}, {"t": 1.0, "event_id": 2100}]))
    assert rows(kept, "id", "category") == [(0, "CONNECT"), (2, "DISCONNECT")]


def test_other_sources_undated_rows_and_missing_devices_pass(spark):
    table = events(spark, [
        {"t": 0, "source": "Browser"}, {"t": 0.5, "source": "Browser"}, {"t": None}, {"t": None},
        {"t": 0, "device": None}, {"t": 0.1, "device": None},
    ])
    assert [i for (i,) in rows(usb_dedup(table), "id")] == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("slice_rows, fan", [(100_000, 64), (40, 3)])
@pytest.mark.parametrize("spread", [40, 400])
def test_random_bursts_match_the_walk(spark, slice_rows, fan, spread):
    rng = random.Random(slice_rows + spread)
    entries = [
        (i, rng.choice("xyz"), rng.randrange(0, spread * 20) / 20, rng.random() < 0.5) for i in range(1500)
    ]
    table = spark.createDataFrame(
        [(i, k, at(t), c) for i, k, t, c in entries], "id long, key string, ts timestamp, connect boolean"
    ).repartition(3)
    settings = CleaningSettings(slice_rows=slice_rows, slice_fan=fan)
    kept = keep_spaced(table, ["key"], F.col("connect"), 1.5, 1.0, settings)
    assert [i for (i,) in sorted(rows(kept, "id"))] == plain_walk(entries, 1.5, 1.0)


def test_regular_heartbeat_over_a_hundred_slices(spark):
    """Which rows are kept depends on the very first one, through every slice and three levels of maps."""
    entries = [(i, "x", float(i), True) for i in range(1000)]
    table = spark.createDataFrame(
        [(i, k, at(t), c) for i, k, t, c in entries], "id long, key string, ts timestamp, connect boolean"
    )
    settings = CleaningSettings(slice_rows=10, slice_fan=5)
    kept = keep_spaced(table, ["key"], F.col("connect"), 1.5, 1.0, settings)
    assert [i for (i,) in sorted(rows(kept, "id"))] == list(range(0, 1000, 2))
    assert kept.columns == table.columns


def test_wide_bounce_window(spark):
    rng = random.Random(3)
    entries = [(i, "x", rng.randrange(0, 3000) / 10, rng.random() < 0.5) for i in range(400)]
    table = spark.createDataFrame(
        [(i, k, at(t), c) for i, k, t, c in entries], "id long, key string, ts timestamp, connect boolean"
    )
    for slice_rows, fan in ((1000, 64), (4, 4)):
        settings = CleaningSettings(slice_rows=slice_rows, slice_fan=fan)
        kept = keep_spaced(table, ["key"], F.col("connect"), 1.0, 3.0, settings)
        assert [i for (i,) in sorted(rows(kept, "id"))] == plain_walk(entries, 1.0, 3.0)


def keys_of(entries):
    return pa.chunked_array([[k for _, k, _, _ in entries]])


@given(
    st.lists(st.tuples(st.sampled_from("xy"), st.integers(0, 60), st.booleans()), min_size=1, max_size=40),
    st.lists(st.integers(1, 39), max_size=6), st.integers(0, 9), st.integers(0, 9),
)
def test_maps_compose_in_any_grouping(found, cuts, duplicate, bounce):
    rule = Rule(duplicate, bounce)
    found = sorted(found)
    t, kind = np.array([f[1] for f in found]), np.array([int(f[2]) for f in found])
    entries = [(i, *f) for i, f in enumerate(found)]
    edges = sorted({0, len(found), *[c for c in cuts if c < len(found)]})
    pieces = [slice(a, b) for a, b in zip(edges, edges[1:])]
    maps = [slice_map(keys_of(entries[p]), t[p], kind[p], rule) for p in pieces]
    start = (rule.far, CONNECT)
    state, kept, before = start, [], None
    for piece, now in zip(pieces, maps):
        if before is not None:
            state = now.entered(before, state, rule)
        kept += [piece.start + int(i) for i in np.flatnonzero(kept_rows(keys_of(entries[piece]), t[piece], kind[piece], state, rule))]
        state, before = now.after(state, rule), now
    last, wanted = {}, []
    for i, key, at_, connect in entries:
        if key in last:
            gap, was = at_ - last[key][0], last[key][1]
            if (connect == was and gap <= duplicate) or (was and not connect and gap < bounce):
                continue
        last[key] = (at_, connect)
        wanted.append(i)
    assert kept == wanted
    left = maps[0]
    for m in maps[1:]:
        left = left.then(m, rule)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = m.then(right, rule)
    for age in range(0, rule.far + 1):
        for was in (CONNECT, OTHER):
            assert left.after((age, was), rule) == right.after((age, was), rule)
    assert left.after(start, rule) == state


def boot(spark, entries):
    return events(spark, [{"t": t, "activity": a, "source": "Security"} for t, a in entries])


def test_startups_within_the_window_are_dropped(spark):
    table = boot(spark, [(0, "LOGON(STARTUP)"), (40, "LOGON(STARTUP)"), (70, "LOGON(STARTUP)"), (71, "LOCK")])
    assert [i for (i,) in rows(startup_dedup(table), "id")] == [0, 2, 3]


def test_logons_after_a_startup_are_dropped_across_cells(spark):
    settings = CleaningSettings()
    table = boot(spark, [(50, "LOGON(STARTUP)"), (65, "LOGON"), (110, "LOGON"), (111, "LOGON"), (49, "LOGON")])
    assert [i for (i,) in rows(without_boot_logons(table, settings=settings), "id")] == [0, 3, 4]


def test_startup_label_is_a_parameter(spark):
    table = boot(spark, [(0, "STARTUP"), (10, "STARTUP"), (20, "LOGON")])
    assert startup_dedup(table).count() == 3
    kept = without_boot_logons(startup_dedup(table, label="STARTUP"), startup="STARTUP")
    assert [i for (i,) in rows(kept, "id")] == [0]


def test_device_filter_and_lookback(spark):
    table = events(spark, [
        {"t": 0, "device": "usb\\vid_9"}, {"t": 0, "device": "PCI\\1"}, {"t": 0, "device": None},
        {"t": 0, "device": "PCI\\1", "source": "Browser"}, {"t": 0, "device": "SWD\\WPDBUSENUM\\x"},
    ])
    assert [i for (i,) in rows(usb_only(table), "id")] == [0, 3, 4]
    as_of = F.to_timestamp(F.lit("2024-01-11 00:00:00"))
    table = events(spark, [{"t": 0}, {"t": -1}, {"t": None}])
    assert [i for (i,) in rows(within_lookback(table, as_of, 10), "id")] == [0]
    assert [i for (i,) in rows(within_lookback(table, as_of, 10, keep_undated=True), "id")] == [0, 2]


def test_whole_cleaning(spark):
    table = events(spark, [
        {"t": 0, "activity": "LOGON(STARTUP)", "source": "System"}, {"t": 5, "activity": "LOGON", "source": "Security"},
        {"t": 9}, {"t": 9.5}, {"t": 30, "device": "PCI\\1"},
    ])
    assert [i for (i,) in rows(clean_host_log(table, settings=replace(CleaningSettings())), "id")] == [0, 2]
