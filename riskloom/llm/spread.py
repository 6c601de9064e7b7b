"""Running sums over large groups without a task that owns a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ``at`` columns hold whole numbers in [0, AT_RANGE).
AT_RANGE = 1 << 32
# Rows that one bucket holds on average.
BUCKET_ROWS = 8192
BUCKET = "__bucket"
# A group is heavy when it holds at least one in so many rows: no table has more heavy groups.
MOST_HEAVY = 1000
# Bits of a filter and of one of its pages: a filter is 8 MB at any size of the table.
FILTER_BITS, PAGE_BITS = 1 << 26, 1 << 15


def hashed_at(*columns: str | Column) -> Column:
    """An evenly spread place in [0, AT_RANGE) from the values of columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(AT_RANGE))


def digest_at(text: Column) -> Column:
    """An evenly spread place in [0, AT_RANGE) that other engines can compute too."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def running_sums(
    rows: DataFrame,
    keys: Sequence[str],
    at: Column,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    n_rows: int,
    attached: DataFrame | None = None,
) -> DataFrame:
    """Sums over the rows of the same key that come before each row.

    Rows are ordered by ``at`` (see ``AT_RANGE``), then by ``order``. ``at`` is cut into
    as many buckets as ``n_rows`` asks for; buckets are totalled, moved by the totals
    of earlier buckets, and summed inside. A task holds one bucket of one key, so a key
    with a third of all rows is shared by many tasks. ``n_rows`` only sets the number of
    buckets, never the result. Keys must not be null. Columns of ``attached``, one row per key, are
    added on the way, through the table of buckets, so that no large key is joined by itself.
    """
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    cut = rows.withColumns({"__at": at, **{f"__v_{n}": v for n, v in sums.items()}}).withColumn(
        BUCKET, F.floor(F.col("__at") * F.lit(buckets) / F.lit(AT_RANGE)).cast("long")
    )
    cell = [*keys, BUCKET]
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        Window.partitionBy(*cell).orderBy("__at", *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        cut.groupBy(*cell).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums])
        .select(*cell, *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums])
    )
    if attached is not None:
        offsets = offsets.join(attached, [*keys])
    return (
        cut.join(offsets, cell)
        .withColumns({
            n: F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) + F.col(f"__o_{n}") for n in sums
        })
        .drop("__at", BUCKET, *[f"__v_{n}" for n in sums], *[f"__o_{n}" for n in sums])
    )


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int, how: str = "left"
) -> DataFrame:
    """Join rows to their group, one row per group in ``groups``, heavy groups apart.

    ``size`` is a column of ``groups`` that says how many rows a group has, of ``total`` in all.
    At most ``MOST_HEAVY`` groups can be heavy; those are broadcast, and their rows meet them
    where they are. The other rows are shuffled by key, those of heavy groups spread evenly.
    ``how`` is left, or left_semi for the rows alone. Keys must not be null.
    """
    values = [c for c in groups.columns if c not in keys]
    heavy = groups.where(F.col(size) * MOST_HEAVY >= total)
    light = groups.where(F.col(size) * MOST_HEAVY < total)
    marked = F.broadcast(heavy.select(*[F.col(k).alias(f"__h_{k}") for k in keys], *[F.col(v).alias(f"__h_{v}") for v in values]))
    met = rows
    for k in keys:
        met = met.withColumn(f"__j_{k}", F.col(k))
    same = [F.col(f"__j_{k}") == F.col(f"__h_{k}") for k in keys]
    met = met.join(marked, same, "left")
    found = F.col(f"__h_{keys[0]}").isNotNull()
    spread = F.when(found, F.xxhash64(*[c for c in rows.columns])).otherwise(F.lit(0))
    others = light.select(
        *[F.col(k).alias(f"__l_{k}") for k in keys], *[F.col(v).alias(f"__l_{v}") for v in values], F.lit(0).cast("long").alias("__l_spread")
    )
    met = met.withColumn("__spread", F.when(found & (spread == 0), F.lit(1).cast("long")).otherwise(spread))
    on = [F.col(f"__j_{k}") == F.col(f"__l_{k}") for k in keys] + [F.col("__spread") == F.col("__l_spread")]
    met = met.join(others, on, "left")
    if how == "left_semi":
        return met.where(found | F.col(f"__l_{keys[0]}").isNotNull()).select(*rows.columns)
    return met.select(*rows.columns, *[F.coalesce(f"__h_{v}", f"__l_{v}").alias(v) for v in values])


def seen_filter(values: DataFrame, hashed: Column, bits: int = FILTER_BITS) -> DataFrame:
    """A filter of the hashes that ``values`` holds, as pages of bits of a fixed total size."""
    at = F.pmod(hashed, F.lit(bits))
    return (
        values.select(F.floor(at / PAGE_BITS).cast("long").alias("__page"), (at % PAGE_BITS).alias("__bit")).distinct()
        .groupBy("__page").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    )


def with_seen(rows: DataFrame, hashed: Column, name: str, pages: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Add whether a hash may be in a ``seen_filter``: never false for one that is, seldom true for another.

    The filter's bounded pages are broadcast, so rows stay where they are whatever the filter holds.
    """
    met = rows.withColumn("__at", F.pmod(hashed, F.lit(bits))).withColumn("__at_page", F.floor(F.col("__at") / PAGE_BITS).cast("long"))
    met = met.join(F.broadcast(pages), F.col("__at_page") == F.col("__page"), "left")
    place = (F.col("__at") % PAGE_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), place % 8 + 1)
    return met.withColumn(name, F.coalesce(byte.bitwiseAND(one) != 0, F.lit(False))).drop("__at", "__at_page", "__page", "__bits")
