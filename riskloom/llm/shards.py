"""Shards of near equal bytes: minimax contiguous partition of ordered groups.

Groups of equal texts stay whole and are ordered by a digest, so shards are runs of that order.
The smallest capacity that needs no more shards than given is found by search; a
capacity is checked greedily, each shard taking groups while they fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.spread import AT_RANGE, hashed_at, running_sums
from riskloom.plans.materialise import stored

SHARDS = 16
# Leading part of the order that is totalled apart: 4096 cells at every size.
_CELLS, _CELL_BITS = 4096, 12
# Group ends that one pass brings to the driver at most.
PARTS = 1 << 14


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32 and group (a digest of the text) of every row; null counts as empty."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(key).alias("key"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("group"),
    )


def ordered_groups(rows: DataFrame) -> DataFrame:
    """Groups in the order of their digest: group, bytes, n, and the sums before and at their end."""
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    lead = F.conv(F.hex(F.substring("group", 1, 4)), 16, 10).cast("long")
    placed = stored(
        groups.withColumn("cell", F.shiftright(lead, 32 - _CELL_BITS)), "shard-groups"
    )
    over = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # One row per cell, at most 4096 of them.
    cells = placed.groupBy("cell").agg(F.sum("bytes").alias("b"), F.sum("n").alias("r")).select(
        "cell", F.coalesce(F.sum("b").over(over), F.lit(0)).alias("cell_bytes"),
        F.coalesce(F.sum("r").over(over), F.lit(0)).alias("cell_rows"),
    )
    inner = F.pmod(F.shiftleft(lead, _CELL_BITS), F.lit(AT_RANGE))
    n_groups = placed.count()
    sums = running_sums(
        placed, ["cell"], inner, [F.col("group")],
        {"bytes_before": F.col("bytes"), "rows_before": F.col("n")}, -(-n_groups // _CELLS), cells,
    )
    return stored(
        sums.select(
            "group", "bytes", "n", (F.col("bytes_before") + F.col("cell_bytes")).alias("bytes_before"),
            (F.col("rows_before") + F.col("cell_rows")).alias("rows_before"),
        ).withColumn("end", F.col("bytes_before") + F.col("bytes")).repartitionByRange("end").sortWithinPartitions("end"),
        "shard-order",
    )


class _Ends:
    """Some group ends, in order, and where between two of them there may be others."""

    def __init__(self):
        self.ends = np.zeros(1, np.int64)
        # Whether other ends lie between this end and the one before it.
        self.more = np.zeros(1, bool)

    def add(self, ends: np.ndarray, counts: np.ndarray, gaps: list[tuple[int, int]]) -> None:
        """Learn the last end of each part of some gaps, and how many ends the part has."""
        kept = ~np.isin(self.ends, [b for _, b in gaps])
        every = np.concatenate([self.ends[kept], ends])
        more = np.concatenate([self.more[kept], counts > 1])
        order = np.argsort(every, kind="stable")
        self.ends, self.more = every[order], more[order]

    def cuts(self, capacity: int, shards: int, latest: bool) -> list[int]:
        """Cuts of greedily filled shards: no later than the true ones, or with ``latest`` no earlier."""
        found = [0]
        for _ in range(shards):
            reach = min(int(self.ends[-1]), found[-1] + capacity)
            k = int(np.searchsorted(self.ends, reach, "right")) - 1
            inside = latest and k + 1 < len(self.ends) and self.more[k + 1]
            found.append(reach if inside else int(self.ends[k]))
        return found


def _least(enough, low: int, high: int) -> int:
    """The smallest number in (low, high] for which ``enough`` holds; it does for ``high``."""
    while high > low + 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def fewest_bytes(order: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> list[int]:
    """Cuts of the partition with the smallest largest shard: 0, the end of each shard.

    The search for the smallest capacity runs on a bounded number of group ends. Greedy cuts over these ends alone are
    no later than the true ones, and cuts that stop anywhere where an end may lie are no earlier: the first prove a
    capacity enough, the second prove one too small. What lies between is decided by looking closer: one pass
    brings the last end of each part of the gaps in which the cuts in question lie. Every pass looks at about
    ``parts`` ends, so passes grow with the logarithm of the number of groups.
    """
    total, largest, n = order.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0)), F.count(F.lit(1))
    ).first()
    if total == 0:
        return [0] * (shards + 1)
    known = _Ends()
    gaps = [(0, int(total))]
    floor, ceiling = max(-(-total // shards), largest) - 1, -(-total // shards) + largest
    while True:
        known.add(*_looked(order, gaps, parts), gaps)
        high = _least(lambda c: known.cuts(c, shards, False)[-1] >= total, floor, int(total))
        low = _least(lambda c: known.cuts(c, shards, True)[-1] >= total, floor, min(high, ceiling))
        if low == high:
            return known.cuts(high, shards, False)
        first, last = known.cuts(low, shards, False), known.cuts(high, shards, True)
        k = np.flatnonzero(known.more)
        touched = np.zeros(len(k), bool)
        for a, b in zip(first[1:], last[1:]):
            touched |= (known.ends[k - 1] < b) & (known.ends[k] > a)
        gaps = [(int(known.ends[i - 1]), int(known.ends[i])) for i in k[touched]]


def _looked(order: DataFrame, gaps: list[tuple[int, int]], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The last end of each part of the gaps (low, high], and the number of ends in it.

    Gaps share the parts by their width, at least two each. Those side by side are one condition for the scan; a
    task sends one row for each part that it meets.
    """
    lows, highs = (np.array(x, np.int64) for x in zip(*gaps))
    step = max(1, int((highs - lows).sum()) // max(2 * len(gaps), parts))
    steps = np.minimum(step, np.maximum(1, (highs - lows) // 2))
    runs: list[list[int]] = []
    for a, b in gaps:
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    end = F.col("end")
    inside = F.lit(False)
    for a, b in runs:
        inside = inside | ((end > a) & (end <= b))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in found:
            ends = np.sort(part.column(0).to_numpy())
            gap = np.searchsorted(highs, ends)
            place = (ends - lows[gap] - 1) // steps[gap]
            last = np.flatnonzero(np.append((np.diff(gap) != 0) | (np.diff(place) != 0), True)) if len(ends) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (gap[last], place[last], ends[last], np.diff(last, prepend=-1))], ["gap", "part", "end", "n"]
            )

    rows = order.where(inside).select("end").mapInArrow(batches, "gap long, part long, end long, n long")
    # At most about ``parts`` rows.
    found = rows.groupBy("gap", "part").agg(F.max("end").alias("end"), F.sum("n").alias("n")).select("end", "n").toArrow()
    return np.asarray(found.column("end")), np.asarray(found.column("n"))


def shard_of(before: Column, cuts: Sequence[int]) -> Column:
    """Shard of a group by the bytes before it."""
    return sum((F.when(before >= c, 1).otherwise(0) for c in cuts[1:-1]), F.lit(0)).cast("int")


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row.

    Rows of equal texts share a shard; a group larger than an even share makes its shard as large
    as itself. Slots count a shard's rows from 0 without a gap, in the order of group and key. Repeated
    rows get slots of their own; null texts have size 1. An empty table gives no rows.
    """
    rows = stored(
        # Equal rows are merged before they are spread again by their turns: none of them owns a task.
        grouped(docs, key, text).groupBy("key", "size", "text_crc32", "group").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n"), "shard-rows",
    )
    order = ordered_groups(rows)
    cuts = fewest_bytes(order, shards)
    placed = order.select("group", "rows_before", shard_of(F.col("bytes_before"), cuts).alias("shard"))
    firsts = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("rows_before")).collect()}
    first = F.coalesce(*[F.when(F.col("shard") == s, n) for s, n in firsts.items()], F.lit(0))
    return running_sums(
        rows, ["group"], hashed_at("key", "copy"), [F.col("key"), F.col("copy")], {"turn": F.lit(1).cast("long")}, rows.count(),
        placed.select("group", "shard", (F.col("rows_before") - first).alias("slot_before")),
    ).select(
        F.col("key").alias(key), "size", "text_crc32", "shard",
        (F.col("slot_before") + F.col("turn")).cast("long").alias("slot"),
    )
