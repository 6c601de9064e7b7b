import random
from datetime import timedelta

from helpers import START, at, rows

from riskloom.config import CalendarSettings, FeatureSettings
from riskloom.operators.daily import daily_logon
from riskloom.operators.sessions import host_session_days, host_sessions, pair_adjacent

LOGON = "id long, user string, ts timestamp, activity string"
PLAIN = FeatureSettings(calendar=CalendarSettings())


def logon_table(spark, entries):
    data = [(i, u, None if t is None else at(t), a) for i, (u, t, a) in enumerate(entries)]
    return spark.createDataFrame(data, LOGON)


def test_only_a_logon_before_a_logoff_has_a_length(spark):
    table = logon_table(spark, [("a", 0, "Logon"), ("a", 60, "Logon"), ("a", 7260, "Logoff")])
    assert rows(pair_adjacent(table, PLAIN), "id", "session_minutes") == [(0, 0.0), (1, 120.0), (2, 0.0)]


def test_session_over_midnight_counts_on_its_first_day(spark):
    table = logon_table(spark, [("a", 23.5 * 3600, "Logon"), ("a", 24.5 * 3600, "Logoff")])
    got = rows(daily_logon(table, PLAIN), "day", "total_active_minutes_day")
    assert [(str(d), m) for d, m in got] == [("2024-01-01", 60.0), ("2024-01-02", 0.0)]


def test_undated_logoff_ends_a_pair_with_unknown_length(spark):
    table = logon_table(spark, [("a", 0, "Logon"), ("a", None, "Logoff"), ("a", None, "Logon")])
    assert rows(pair_adjacent(table, PLAIN), "id", "session_minutes") == [(0, 0.0), (1, 0.0), (2, 0.0)]
    got = daily_logon(table, PLAIN).collect()
    assert [(str(r["day"]), r["logon_count"]) for r in got] == [("2024-01-01", 1)]


def test_null_users_give_no_day(spark):
    table = logon_table(spark, [(None, 0, "Logon"), ("a", 0, "Logon")])
    assert [r["user"] for r in daily_logon(table, PLAIN).collect()] == ["a"]


def test_random_pairs_match_a_plain_walk(spark):
    rng = random.Random(5)
    entries = [
        (rng.choice("ab"), rng.choice([None, *[rng.randrange(0, 40_000) for _ in range(9)]]),
         rng.choice(["Logon", "Logoff"])) for _ in range(300)
    ]
    expected = {}
    for user in "ab":
        own = [(t is None, t or 0, i, a) for i, (u, t, a) in enumerate(entries) if u == user]
        own.sort()
        for here, following in zip(own, own[1:] + [None]):
            minutes = 0.0
            if here[3] == "Logon" and following and following[3] == "Logoff" and not following[0] and not here[0]:
                minutes = (following[1] - here[1]) / 60
            expected[here[2]] = minutes
    got = dict(rows(pair_adjacent(logon_table(spark, entries), PLAIN), "id", "session_minutes"))
    assert got == expected


def days_of(spark, entries):
    got = host_session_days(logon_table(spark, [("a", t, a) for t, a in entries]), PLAIN).collect()
    assert len(got) == 1
    return got[0]


STARTUP, SHUTDOWN = "LOGON(STARTUP)", "LOGOFF(shutdown)"


def test_later_openers_are_ignored(spark):
    day = days_of(spark, [(28800, STARTUP), (30000, "UNLOCK"), (36000, "LOCK")])
    assert (day["total_active_minutes_day"], day["logon_count"]) == (120.0, 1)


def test_startup_inside_a_session_is_not_counted(spark):
    day = days_of(spark, [(28800, "UNLOCK"), (30000, STARTUP), (36000, "LOCK")])
    assert (day["total_active_minutes_day"], day["logon_count"]) == (120.0, 0)


def test_day_without_startup_has_no_total(spark):
    day = days_of(spark, [(3600, "UNLOCK"), (7200, "LOCK")])
    assert day["total_active_minutes_day"] is None
    assert day["after_hours_session_count"] == 1


def test_open_session_without_shutdown_has_no_total(spark):
    day = days_of(spark, [(3600, STARTUP)])
    assert day["total_active_minutes_day"] is None
    assert day["after_hours_session_count"] == 0


def test_open_session_after_a_shutdown_runs_to_midnight(spark):
    day = days_of(spark, [(36000, SHUTDOWN), (22 * 3600, STARTUP)])
    assert (day["total_active_minutes_day"], day["after_hours_session_count"]) == (120.0, 1)


def walk_day(events):
    """One user-day by the rule, event by event."""
    total, after, logons, opened = 0.0, 0, 0, None
    names = [a for _, _, a in events]
    for t, _, activity in events:
        if activity in (STARTUP, "UNLOCK", "WAKE") and opened is None:
            opened, logons = t, logons + (activity == STARTUP)
        elif activity in (SHUTDOWN, "LOCK", "SLEEP") and opened is not None:
            total += (t - opened) / 60
            after += not 7 <= (opened % 86400) // 3600 < 19
            opened = None
    if opened is not None:
        if SHUTDOWN in names:
            total += (86400 - opened % 86400) / 60
            after += not 7 <= (opened % 86400) // 3600 < 19
        else:
            total = None
    return (None if STARTUP not in names or total is None else round(total, 6), after, logons)


def test_random_host_days_match_the_walk(spark):
    rng = random.Random(11)
    kinds = [STARTUP, "UNLOCK", "WAKE", SHUTDOWN, "LOCK", "SLEEP", "LOGON", None]
    entries = [("a", rng.randrange(0, 20 * 86400), rng.choice(kinds)) for _ in range(400)]
    by_day = {}
    for i, (_, t, a) in enumerate(entries):
        by_day.setdefault(t // 86400, []).append((t, i, a))
    expected = {START.date() + timedelta(days=d): walk_day(sorted(e, key=lambda x: x[:2])) for d, e in by_day.items()}
    got = host_session_days(logon_table(spark, entries), PLAIN).collect()
    actual = {
        r["day"]: (r["total_active_minutes_day"] and round(r["total_active_minutes_day"], 6),
                   r["after_hours_session_count"], r["logon_count"]) for r in got
    }
    assert actual == expected


def test_host_sessions_cross_cells(spark):
    table = logon_table(spark, [("a", 0, STARTUP), ("a", 5000, "WAKE"), ("a", 9000, "LOCK")])
    got = host_sessions(table, PLAIN).collect()
    assert [(r["open_ts"], r["close_ts"]) for r in got] == [(at(0), at(9000))]


def test_a_user_with_most_rows_of_one_hour_is_cut_by_rows(spark):
    from riskloom.operators.cells import CELL, sliced

    hot = [("u", at(i * 0.3), i, "Logon" if i % 3 else "Logoff") for i in range(9000)]
    cold = [(f"v{i % 50}", at(i * 600.0), 100_000 + i, "Logon") for i in range(1000)]
    table = spark.createDataFrame(hot + cold, "user string, ts timestamp_ntz, id long, activity string")
    sizes = [r["count"] for r in sliced(table, ["user"], ("ts", "id")).groupBy(CELL).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1.5 * 10_000 / len(sizes)
    got = {r["id"]: r["session_minutes"] for r in pair_adjacent(table, PLAIN).collect()}
    for n, (_, _, key, activity) in enumerate(hot):
        paired = activity == "Logon" and n + 1 < len(hot) and hot[n + 1][3] == "Logoff"
        assert abs(got[key] - (0.005 if paired else 0.0)) < 1e-6
