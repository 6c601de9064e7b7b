import random

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from riskloom.operators.cleaning import keep_spaced
from riskloom.operators.daily import daily_device, daily_web
from riskloom.operators.spaced import Rule
from riskloom.plans.materialise import new_path
from riskloom.streaming import days, replay, spaced

RULE = Rule(1_500_000, 1_000_000)


def test_replayed_rule_equals_the_batch_rule(spark):
    rng = random.Random(4)
    data = [(i, rng.choice("ab"), rng.choice(["x", "y", None]), at(rng.randrange(0, 4_000) / 10), rng.random() < 0.5) for i in range(900)]
    data += [(1_000, None, "x", at(5), True), (1_001, "a", "x", None, True)]
    table = spark.createDataFrame(data, "id long, user string, device string, ts timestamp, connect boolean").repartition(3)
    keys = ["user", "device"]
    want = keep_spaced(table, keys, F.col("connect"), 1.5, 1.0).where("user is not null and device is not null and ts is not null")
    got = replay.replayed(
        spark, replay.lay_out(table, slices=5), lambda live: spaced.stream_spaced(live, keys, F.col("connect"), RULE, "20 seconds"), "rule"
    )
    assert rows(got, "id") == rows(want, "id") and got.count() > 300


def write(spark, folder, entries):
    spark.createDataFrame(
        [(i, "a", "x", at(t), True) for i, t in entries], "id long, user string, device string, ts timestamp, connect boolean"
    ).coalesce(1).write.mode("append").parquet(folder)


def test_rows_out_of_order_are_judged_in_order_and_late_ones_left_out(spark):
    folder = new_path(spark, "late")
    write(spark, folder, [(1, 0.0), (2, 2.0), (3, 10.0)])
    write(spark, folder, [(4, 1.0), (5, 9.0)])          # within the delay: 5 comes before 3, 4 before 2
    write(spark, folder, [(6, 100.0)])
    write(spark, folder, [(8, 101.0)])
    write(spark, folder, [(7, 4.0), (9, 500.0)])        # 7 is later than the delay allows: its time is judged
    write(spark, folder, [(10, 900.0)])
    got = replay.replayed(
        spark, folder, lambda live: spaced.stream_spaced(live, ["user", "device"], F.col("connect"), RULE, "30 seconds"), "late"
    )
    # 4 repeats 1, 2 follows 1 by 2 s; 3 repeats 5; 8 repeats 6; 10 still waits for the watermark.
    assert sorted(i for (i,) in rows(got, "id")) == [1, 2, 5, 6, 9]


@pytest.mark.parametrize("buckets", [1, 3])
def test_keys_of_one_bucket_share_a_state(spark, buckets):
    """More keys than buckets: every key is still judged by its own rows, and Python is called for buckets alone."""
    rng = random.Random(17)
    data = [(i, f"u{rng.randrange(9)}", f"d{rng.randrange(2)}", at(rng.randrange(0, 400)), rng.random() < 0.5) for i in range(900)]
    table = spark.createDataFrame(data, "id long, user string, device string, ts timestamp, connect boolean")
    keys = ["user", "device"]
    want = keep_spaced(table, keys, F.col("connect"), 1.5, 1.0)
    got = replay.replayed(
        spark, replay.lay_out(table, slices=4),
        lambda live: spaced.stream_spaced(live, keys, F.col("connect"), RULE, "20 seconds", buckets=buckets), "buckets"
    )
    assert rows(got, *keys, "id") == rows(want, *keys, "id") and 0 < got.count() < 900


def test_state_is_removed_once_it_can_drop_nothing(spark):
    kept, last = spaced.kept_in_order([(0, 1, 1), (1_000_000, 2, 1), (1_600_000, 3, 1), (1_700_000, 4, 0), (9_000_000, 5, 0)], None, RULE)
    assert kept == [1, 3, 5] and last == (9_000_000, 0)
    assert spaced.kept_in_order([], last, RULE) == ([], last)


@pytest.mark.parametrize("slices", [1, 6])
def test_streamed_days_equal_the_batch_days(spark, slices):
    rng = random.Random(9)
    data = [(i, rng.choice(["a", "b", "c", None]), at(rng.randrange(0, 9 * 86400)), rng.choice(["Connect", "Disconnect"]), rng.choice(["http://job.example", "http://x.example"])) for i in range(600)]
    table = spark.createDataFrame(data, "id long, user string, ts timestamp, activity string, url string")
    folder = replay.lay_out(table, slices)
    for stream, batch in ((days.device_days, daily_device), (days.web_days, daily_web)):
        got, want = replay.replayed(spark, folder, stream, "days"), batch(table)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, *want.columns) == rows(want, *want.columns)


def test_an_empty_log_gives_no_days(spark):
    table = spark.createDataFrame([], "id long, user string, ts timestamp, activity string, url string")
    assert replay.replayed(spark, replay.lay_out(table), days.web_days, "days").count() == 0


def test_a_stopped_replay_goes_on(spark):
    """The second run of a stream reads only what is new: no day is given twice."""
    folder, path = new_path(spark, "live"), new_path(spark, "live-out")
    schema = "user string, ts timestamp, url string"

    def add(entries):
        spark.createDataFrame([(u, at(t * 86400), "job") for u, t in entries], schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        days.web_days(live).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option(
            "checkpointLocation", f"{path}-state").start(path).awaitTermination()
        return sorted((r["user"], str(r["day"])) for r in spark.read.parquet(path).collect())

    add([("a", 0.2), ("b", 0.4)])
    add([("a", 3.2)])
    first = run()
    assert len(first) == 2
    add([("a", 9.1)])
    second = run()
    assert len(second) == len(set(second)) == 3
