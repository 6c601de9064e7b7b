import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from riskloom.operators.cells import whole_cells
from riskloom.operators.ordering import exact_quantiles, global_rank, heavy_values, row_slices, running_totals


def test_rank_is_a_total_order(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([0.0, 0.0, 0.0, rng.random()]), rng.choice("ab")) for i in range(500)]
    table = spark.createDataFrame(data, "id long, score double, grp string")
    got = rows(global_rank(table, [F.col("score").desc(), F.col("id")]), "id", "rank")
    expected = {i: n + 1 for n, (i, _, _) in enumerate(sorted(data, key=lambda d: (-d[1], d[0])))}
    assert dict(got) == expected
    grouped = dict(rows(global_rank(table, [F.col("score"), F.col("id")], groups=["grp"]), "id", "rank"))
    for g in "ab":
        own = sorted((d for d in data if d[2] == g), key=lambda d: (d[1], d[0]))
        assert {d[0]: n + 1 for n, d in enumerate(own)} == {d[0]: grouped[d[0]] for d in own}


def test_running_totals_add_up(spark):
    table = spark.range(300).select("id", (F.col("id") % 7).alias("v"))
    got = dict(rows(running_totals(table, [F.col("id")], {"upto": "v"}), "id", "upto"))
    total = 0
    for i in range(300):
        total += i % 7
        assert got[i] == total


@pytest.mark.parametrize("size", [1, 2, 101])
def test_quantiles_equal_linear_interpolation(spark, size):
    rng = np.random.default_rng(size)
    x = np.where(rng.random(size) < 0.4, 0.5, rng.normal(size=size))
    data = [(float(v), None if i % 3 else float(v) ** 2) for i, v in enumerate(x)]
    table = spark.createDataFrame(data, "x double, y double")
    wanted = {"a": ("x", 0.5), "b": ("x", 0.02), "c": ("x", 0.99), "d": ("y", 0.25)}
    got = exact_quantiles(table, {"x": "x", "y": "y"}, wanted).first()
    y = np.array([d[1] for d in data if d[1] is not None])
    for name, values, p in (("a", x, 0.5), ("b", x, 0.02), ("c", x, 0.99), ("d", y, 0.25)):
        assert got[name] == pytest.approx(np.quantile(values, p), abs=1e-12)


@pytest.mark.parametrize("n", [0, 1, 500, 5_000, 50_000])
def test_no_slice_holds_more_rows_than_asked(spark, n):
    """Ten times the rows with the same four partitions give ten times the slices, not larger ones."""
    table = spark.range(n).select((F.col("id") % 3 * 1_000_000_000 + F.col("id") * F.col("id")).alias("at"), "id").repartition(5)
    cut = row_slices(table, [F.col("at"), F.col("id")], "slice", most=100).cache()
    sizes = cut.groupBy("slice").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).orderBy("slice").collect()
    assert sum(r["n"] for r in sizes) == n and all(r["n"] <= 100 for r in sizes)
    assert all(a["high"] <= b["low"] for a, b in zip(sizes, sizes[1:]))
    assert cut.withColumn("p", F.spark_partition_id()).select("p", "slice").distinct().count() == len(sizes)
    cut.unpersist()


def test_one_order_value_for_most_rows(spark):
    """The place in the order tells equal values apart, so a value with all rows is cut too."""
    table = spark.range(3_000).select(F.lit("hot").alias("user"), "id")
    sizes = row_slices(table, [F.col("user"), F.col("id")], "slice", most=64).groupBy("slice").count().collect()
    assert max(r["count"] for r in sizes) <= 64 and len(sizes) >= 3_000 // 64


def test_totals_over_many_slices(spark):
    table = spark.range(3_000).select("id", (F.col("id") % 7).alias("v"), (F.col("id") % 2).alias("g"))
    got = dict(rows(running_totals(table, [F.col("id")], {"upto": "v"}, ["g"], most=50), "id", "upto"))
    total = {0: 0, 1: 0}
    for i in range(3_000):
        total[i % 2] += i % 7
        assert got[i] == total[i % 2]


def test_slices_come_whole_from_batches():
    import pyarrow as pa

    numbers = [0, 0, 0, 4, 4, 9, 9, 9, 9, 12]
    whole = pa.table({"__cell": pa.array(numbers, pa.int64()), "v": list(range(10))})
    parts = [b for k in (0, 2, 3, 7) for b in whole.slice(k, {0: 2, 2: 1, 3: 4, 7: 3}[k]).to_batches()]
    got = [(cell, part.column("v").to_pylist()) for cell, part in whole_cells(iter(parts))]
    assert got == [(0, [0, 1, 2]), (4, [3, 4]), (9, [5, 6, 7, 8]), (12, [9])]


@pytest.mark.parametrize("accuracy, few", [(10_000, 4096), (20, 3), (4, 1)])
def test_quantiles_by_selection_at_any_accuracy(spark, accuracy, few):
    """Poor sketches and tight bounds only take more rounds."""
    rng = np.random.default_rng(7)
    x = np.concatenate([np.full(700, 0.25), rng.normal(size=900), rng.integers(-3, 3, 400)])
    table = spark.createDataFrame([(float(v),) for v in rng.permutation(x)], "x double").repartition(7)
    probabilities = (0.0, 0.01, 0.02, 0.33, 0.5, 0.63, 0.95, 0.98, 0.99, 1.0)
    got = exact_quantiles(table, {"x": "x"}, {f"q{i}": ("x", p) for i, p in enumerate(probabilities)}, accuracy, few).first()
    for i, p in enumerate(probabilities):
        assert got[i] == pytest.approx(np.quantile(x, p), abs=1e-12)


def test_quantiles_of_nothing_of_one_value_and_of_infinities(spark):
    rows = [(None, 1.0, float("nan")), (None, 1.0, float("inf")), (None, 1.0, -float("inf")), (None, 1.0, 2.0), (None, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "a double, b double, c double")
    wanted = {"a": ("a", 0.5), "b": ("b", 0.3), "c": ("c", 0.5), "d": ("c", 0.25)}
    assert tuple(exact_quantiles(table, {k: k for k in "abc"}, wanted).first()) == (None, 1.0, 2.0, 1.0)
    assert exact_quantiles(table.where("false"), {"b": "b"}, {"b": ("b", 0.3)}).first()[0] is None


def shuffled_rows(spark, run):
    """Rows written to shuffles by ``run``, from the plans it executes."""
    import io
    import json
    import os
    import tempfile

    import zstandard

    folder = tempfile.mkdtemp()
    path = os.path.join(folder, "seen")
    context = spark.sparkContext
    listener = context._jvm.org.apache.spark.scheduler.EventLoggingListener(
        "seen", context._jvm.scala.Option.empty(), context._jvm.java.net.URI(f"file://{folder}"), context._jsc.sc().conf()
    )
    listener.start()
    context._jsc.sc().addSparkListener(listener)
    try:
        run()
    finally:
        context._jsc.sc().listenerBus().waitUntilEmpty()
        context._jsc.sc().removeSparkListener(listener)
        listener.stop()
    total = 0
    found = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if "events" in f or f.startswith("seen")]
    for name in found:
        with open(name, "rb") as raw:
            packed = raw.read(4) == b"\x28\xb5\x2f\xfd"
            raw.seek(0)
            stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) if packed else raw
            for line in io.TextIOWrapper(stream, encoding="utf-8"):
                event = json.loads(line)
                if event.get("Event") == "SparkListenerTaskEnd":
                    total += event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Records Written"]
    return total


def test_quantiles_and_heavy_values_move_few_rows(spark):
    n = 20_000
    table = spark.range(n).select(F.rand(3).alias("x"), F.rand(4).alias("y"), F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.rand(5)).alias("z")).repartition(4).cache()
    table.count()
    wanted = {f"{c}{p}": (c, p) for c in "xyz" for p in (0.02, 0.5, 0.95, 0.99)}
    moved = shuffled_rows(spark, lambda: exact_quantiles(table, {c: c for c in "xyz"}, wanted).collect())
    assert 0 < moved < n // 4
    moved = shuffled_rows(spark, lambda: heavy_values(table, {"z": "z"}).collect())
    assert 0 < moved < n // 20
    table.unpersist()


def test_heavy_values_are_exact(spark):
    rng = random.Random(2)
    rows = [(float(rng.choice([1, 1, 1, 2, 3])), float(i), None if i % 2 else 5.0, None, float(i % 150)) for i in range(3_000)]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    got = {r["metric"]: (r["n"], r["top"]) for r in heavy_values(table, {c.upper(): c for c in "abcde"}).collect()}
    ones = sum(r[0] == 1.0 for r in rows)
    assert got == {"A": (3_000, ones), "B": (3_000, 1), "C": (1_500, 1_500), "E": (3_000, 20)}
