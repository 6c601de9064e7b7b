"""Exact global ranks, running totals and quantiles without a one-task window."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.plans.materialise import checkpointed, stored

SLICE = "__slice"
# Rows that a slice of ordered rows holds at most.
SLICE_ROWS = 65_536
# A partition id of monotonically_increasing_id stands above this bit, the place in the partition below.
_PLACE_BITS = 33


def row_slices(df: DataFrame, order: Sequence[Column], name: str, most: int = SLICE_ROWS) -> DataFrame:
    """Add a slice number: ranges of ``order`` with at most ``most`` rows each, sorted inside.

    Range bounds come from keys that every task samples, with as many ranges as the rows ask for (and
    enough to use all cores). Samples only make ranges even on average, so a range is then cut by
    place: the bound holds at any size and for any distribution. Slices are numbered in order, and every
    slice lies in one partition. The order must identify a row. Write the result before it is used twice.
    """
    spark = df.sparkSession
    n = df.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * n // most))
    row = F.monotonically_increasing_id()
    return (
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("__row", row)
        .withColumn(name, F.shiftright("__row", _PLACE_BITS) * (1 << _PLACE_BITS) + F.floor((F.col("__row") % (1 << _PLACE_BITS)) / most))
        .drop("__row")
    )


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, str],
    groups: Sequence[str] = (),
    with_total: bool = False,
    most: int = SLICE_ROWS,
) -> DataFrame:
    """Running totals over the whole table, or over each of a few large groups.

    ``sums`` maps each output column to the column it adds up, the current row
    included; ``with_total`` adds the group's whole sum as ``<name>_total``. Rows are cut into sorted slices of at most ``most`` rows, totalled inside each slice,
    and moved by the totals of the slices before it. The slices are written once, so
    a task that is run again sees the same cut. The order must identify each row.
    """
    cut = checkpointed(row_slices(df, [*[F.col(g) for g in groups], *order], SLICE, most))
    inside = Window.partitionBy(*groups, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*groups)
    keys = [*groups, SLICE]
    # One row per group and slice.
    offsets = (
        cut.groupBy(*keys)
        .agg(*[F.sum(source).alias(name) for name, source in sums.items()])
        .select(*keys, *[
            F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"__before_{name}")
            for name in sums
        ], *[F.sum(name).over(every).alias(f"{name}_total") for name in sums if with_total])
    )
    return (
        cut.select("*", *[F.sum(source).over(inside).alias(f"__in_{name}")
                          for name, source in sums.items()])
        .join(offsets, keys)
        .withColumns({n: F.col(f"__in_{n}") + F.col(f"__before_{n}") for n in sums})
        .drop(SLICE, *[f"__in_{n}" for n in sums], *[f"__before_{n}" for n in sums])
    )


def global_rank(
    df: DataFrame, order: Sequence[Column], name: str = "rank", groups: Sequence[str] = ()
) -> DataFrame:
    """Position 1..n in a total order, over the table or over a few large groups."""
    return (
        running_totals(df.withColumn("__one", F.lit(1).cast("long")), order, {name: "__one"}, groups)
        .drop("__one")
        .withColumn(name, F.col(name).cast("long"))
    )


def value_counts(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Rows (metric, value, n) for each column; null values are left out.

    Equal values are merged before the shuffle, so a value that fills a third of the
    table costs one row per task.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.col(column).cast("double").alias("value"))
        for metric, column in columns.items()
    ]))
    return (
        df.select(pairs.alias("p")).select("p.metric", "p.value")
        .where(F.col("value").isNotNull())
        .groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass
class _Bracket:
    """What is known of one quantile: its two 0-based positions, and values that enclose them."""

    column: str
    p: float
    n: int
    low: float = -math.inf
    high: float = math.inf
    # Rows of the column that are smaller than ``low``, and rows strictly between the two values.
    below: int = 0
    inside: int = 0

    @property
    def at(self) -> float:
        """Position of the quantile between the sorted rows."""
        return self.p * (self.n - 1)

    @property
    def positions(self) -> tuple[int, int]:
        """The two positions it lies between."""
        return math.floor(self.at), math.ceil(self.at)


def _sketched(rows: DataFrame, brackets: Mapping[str, _Bracket], accuracy: int) -> None:
    """Tighten brackets by one mergeable sketch each, over the rows inside it; a task sends one row."""
    wide = 2.0 / accuracy
    asked = []
    for name, b in brackets.items():
        value = F.col(b.column)
        held = F.when((value >= b.low) & (value <= b.high), value)
        first, last = ((x - b.below) / max(1, b.inside) for x in b.positions)
        asked.append(F.percentile_approx(held, F.array(
            F.lit(min(1.0, max(0.0, first - wide))), F.lit(min(1.0, max(0.0, last + wide)))
        ), accuracy).alias(name))
    found = rows.agg(*asked).first()
    for name, b in brackets.items():
        if found[name] is not None:
            b.low, b.high = found[name]


def _counted(rows: DataFrame, brackets: Mapping[str, _Bracket]) -> list[str]:
    """Count exactly where the brackets lie; gives the names of those that missed and were opened on that side."""
    asked = []
    for name, b in brackets.items():
        value = F.col(b.column)
        asked.append(F.struct(
            F.count_if(value < b.low).alias("below"), F.count_if(value <= b.high).alias("upto"),
            F.count_if((value > b.low) & (value < b.high)).alias("inside"),
        ).alias(name))
    found, missed = rows.agg(*asked).first(), []
    for name, b in brackets.items():
        b.below, b.inside = found[name]["below"], found[name]["inside"]
        if b.positions[0] < b.below:
            b.low, b.below = -math.inf, 0
            missed.append(name)
        if b.positions[1] >= found[name]["upto"]:
            b.high = math.inf
            missed.append(name)
    return missed


def exact_quantiles(
    df: DataFrame, columns: Mapping[str, str], wanted: Mapping[str, tuple[str, float]],
    accuracy: int = 10_000, few: int = 4096,
) -> DataFrame:
    """One row of exact linearly interpolated quantiles.

    ``columns`` maps a metric to a column and ``wanted`` an output name to (metric, probability). Quantiles are
    selected, not sorted for: a mergeable sketch encloses each one between two values, a pass counts the rows
    below and between them exactly, and this repeats inside the bracket (each round leaves about four in ``accuracy`` of
    its rows) until ``few`` rows are left, of which the wanted positions are picked. A bracket that the count proves wrong
    is opened again, so the sketch decides the speed and never the result. Values are written once, as
    doubles; null is left out and NaN counts as infinity. No rows give null.
    """
    spark = df.sparkSession
    used = sorted({columns[metric] for metric, _ in wanted.values()})
    short = {c: f"c{i}" for i, c in enumerate(used)}
    rows = stored(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(math.inf)).alias(short[c]) for c in used]), "quantiles")
    sizes = rows.agg(*[F.count(c).alias(c) for c in short.values()]).first()
    brackets = {
        name: _Bracket(short[columns[metric]], float(p), sizes[short[columns[metric]]])
        for name, (metric, p) in wanted.items() if sizes[short[columns[metric]]]
    }
    for b in brackets.values():
        b.inside = b.n
    open_ = dict(brackets)
    while open_:
        before = {name: b.inside for name, b in open_.items()}
        _sketched(rows, open_, accuracy)
        missed = set(_counted(rows, open_))
        while missed:
            missed = set(_counted(rows, {name: open_[name] for name in missed}))
        open_ = {name: b for name, b in open_.items() if b.low < b.high and few < b.inside < before[name]}
    values = _picked(rows, {name: b for name, b in brackets.items() if b.low < b.high})
    out = []
    for name in wanted:
        b = brackets.get(name)
        low, high = values.get(name, (b.low, b.high)) if b else (None, None)
        out.append(None if b is None else low + (high - low) * (b.at - b.positions[0]) if low != high else low)
    return spark.createDataFrame([tuple(out)], ", ".join(f"`{name}` double" for name in wanted))


def _picked(rows: DataFrame, brackets: Mapping[str, _Bracket]) -> dict[str, tuple[float, float]]:
    """The values at the two positions of each bracket, from its few rows; equal values are one row."""
    if not brackets:
        return {}
    pairs = F.filter(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(b.column).alias("value"), F.lit(b.below).alias("below"),
                 F.lit(b.positions[0]).alias("first"), F.lit(b.positions[1]).alias("last"),
                 F.coalesce(F.col(b.column).between(b.low, b.high), F.lit(False)).alias("held"))
        for name, b in brackets.items()
    ]), lambda s: s["held"])
    counts = rows.select(F.inline(pairs)).groupBy("name", "value", "below", "first", "last").agg(F.count(F.lit(1)).alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("name").orderBy("value"))
    here = lambda c: (F.col(c) < F.col("upto")) & (F.col(c) >= F.col("upto") - F.col("n"))
    found = counts.withColumn("upto", upto).groupBy("name").agg(
        F.max(F.when(here("first"), F.col("value"))).alias("a"), F.max(F.when(here("last"), F.col("value"))).alias("b")
    ).collect()
    return {r["name"]: (r["a"], r["b"]) for r in found}


def heavy_values(df: DataFrame, columns: Mapping[str, str], support: float = 0.01) -> DataFrame:
    """Rows (metric, n, top): filled rows of each column and the rows of its most frequent value.

    A mergeable summary of frequent items names at most 1 / ``support`` candidates a column, and one pass counts
    them: what is moved does not depend on the number of distinct values. The candidates hold every value with that share;
    only columns that have none are counted value by value.
    """
    spark = df.sparkSession
    short = {f"c{i}": metric for i, metric in enumerate(columns)}
    rows = stored(df.select(*[F.col(columns[m]).cast("double").alias(c) for c, m in short.items()]), "heavy-values")
    sizes = rows.agg(*[F.count(c).alias(c) for c in short]).first()
    # One row: a few values a column.
    named = rows.freqItems(list(short), support).first()
    wanted = {c: sorted({v for v in named[f"{c}_freqItems"] if v is not None}) for c in short}
    pairs = F.array(*[
        F.struct(F.lit(c).alias("c"), F.when(F.col(c).isin(values), F.col(c)).alias("value")) for c, values in wanted.items() if values
    ] or [F.struct(F.lit("").alias("c"), F.lit(None).cast("double").alias("value"))])
    counted = (
        rows.select(F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("c").agg(F.max("n").alias("top")).collect()
    )
    top = {r["c"]: r["top"] for r in counted}
    spread = [c for c in short if sizes[c] and top.get(c, 0) < support * sizes[c]]
    if spread:
        full = value_counts(rows, {c: c for c in spread}).groupBy("metric").agg(F.max("n").alias("top"))
        top.update({r["metric"]: r["top"] for r in full.collect()})
    return spark.createDataFrame(
        [(metric, sizes[c], top[c]) for c, metric in short.items() if sizes[c]], "metric string, n long, top long"
    )


def all_of(conditions: Sequence[Column]) -> Column:
    """Conjunction of conditions."""
    return reduce(lambda a, b: a & b, conditions)
