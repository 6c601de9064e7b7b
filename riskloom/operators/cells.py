"""Ordered work on keys of any size.

A window per user puts all rows of a busy user in one task. Here the rows are sorted by
key and order and cut by range into slices of a bounded number of rows; the window runs per (key, slice), and
what a slice needs from its neighbours is brought in from a table with one row per
key and slice. How a key's rows lie in time does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ordering import SLICE_ROWS, row_slices
from riskloom.plans.materialise import checkpointed

CELL = "__cell"
COPY = "__copy"


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = SLICE_ROWS) -> DataFrame:
    """Add the slice of each row: ranges of (keys, order), nulls of the order last, at most ``most`` rows each.

    The rows are written once, slice by slice and in order, so a task that is run again sees the same cut.
    The order must identify a row in its key.
    """
    by = [*[F.col(k) for k in keys], *[F.col(c).asc_nulls_last() for c in order]]
    return checkpointed(row_slices(df, by, CELL, most))


def whole_cells(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Slices, one at a time, from batches that are sorted by slice."""
    held: list[pa.RecordBatch] = []
    now = None
    for part in parts:
        if part.num_rows == 0:
            continue
        numbers = part.column(part.schema.get_field_index(CELL)).to_numpy()
        edges = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
        for begin, end in zip([0, *edges], [*edges, part.num_rows]):
            if held and numbers[begin] != now:
                yield int(now), pa.Table.from_batches(held).combine_chunks()
                held = []
            now = numbers[begin]
            held.append(part.slice(begin, end - begin))
    if held:
        yield int(now), pa.Table.from_batches(held).combine_chunks()


def carried_from(
    df: DataFrame, keys: Sequence[str], value: Column, name: str, side: str
) -> DataFrame:
    """Per key and slice, the nearest non-null ``value`` of the slices before or after it.

    ``value`` is an aggregate over a slice; ``side`` is 'previous' or 'next'.
    """
    order = Window.partitionBy(*keys).orderBy(CELL)
    cells = df.groupBy(*keys, CELL).agg(value.alias("__value"))
    if side == "previous":
        near = F.last("__value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    else:
        near = F.first("__value", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return cells.select(*keys, CELL, near.alias(name))


def cell_window(keys: Sequence[str], order: Sequence[Column]):
    """Rows of one key and slice, in order."""
    return Window.partitionBy(*keys, CELL).orderBy(*order)


def with_neighbour_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], side: str
) -> DataFrame:
    """Copy into each cell the nearest row of the neighbouring non-empty cell.

    ``side`` 'next' copies the first row of the following cell, so ``lead`` is right
    on the last row of a cell; 'previous' copies the last row of the preceding cell,
    so ``lag`` is right on the first. Copies are marked in ``COPY``; drop them after
    the window. ``order`` columns sort nulls last and must identify a row in its key.
    """
    picked = F.struct(*columns)
    position = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order])
    toward = Window.partitionBy(*keys).orderBy(CELL)
    if side == "next":
        edge, target = F.min_by(picked, position), F.lag(CELL).over(toward)
    else:
        edge, target = F.max_by(picked, position), F.lead(CELL).over(toward)
    copies = (
        df.groupBy(*keys, CELL)
        .agg(edge.alias("__edge"))
        .withColumn("__target", target)
        .where(F.col("__target").isNotNull())
        .select(*keys, F.col("__target").alias(CELL), "__edge.*", F.lit(True).alias(COPY))
    )
    return df.withColumn(COPY, F.lit(False)).unionByName(copies, allowMissingColumns=True)


def without_copies(df: DataFrame) -> DataFrame:
    """Drop the copied rows."""
    return df.where(~F.col(COPY)).drop(COPY)
