"""The last-kept rule on a live log: keyed state, and timers of event time.

A row is judged once the watermark has passed it, so rows that come out of order within the delay are judged in
order. What is known of a key is the row kept last and the rows that still wait; it goes when no row
can be dropped because of it any more. Keys are dealt to a fixed number of buckets, and a bucket holds its keys in one state: a
call of Python costs the same for one key as for hundreds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.functions.calendar import micros
from riskloom.operators.spaced import CONNECT, OTHER, Rule
from riskloom.streaming.replay import CLOSING, event_time

# Keys that lie in one bucket share a state and a timer. A stream that goes on keeps the number it began with.
BUCKETS = 2048
# Columns of the keys are arrays, a place for each key; of the waiting rows too, with the place of their key.
_KNOWN = "last_t array<long>, last_c array<int>, at array<int>, t array<long>, id array<long>, c array<int>"


def kept_in_order(
    waiting: list[tuple[int, int, int]], last: tuple[int, int] | None, rule: Rule
) -> tuple[list[int], tuple[int, int] | None]:
    """Ids kept of sorted rows (time, id, kind) after the row kept last, and the row kept last then."""
    kept = []
    for t, row, kind in waiting:
        if last is not None:
            gap = t - last[0]
            if (kind == last[1] and gap <= rule.duplicate) or (last[1] == CONNECT and kind == OTHER and gap < rule.bounce):
                continue
        last = (t, kind)
        kept.append(row)
    return kept, last


def stream_spaced(
    events: DataFrame, keys: Sequence[str], connect: Column, rule: Rule, delay: str = "10 minutes", buckets: int = BUCKETS
) -> DataFrame:
    """(keys, id) of the rows that the rule keeps, of rows with ts, id and keys; rows later than ``delay`` are left out."""
    known = F.col("ts").isNotNull()
    for key in keys:
        known = known & (F.col(key).isNotNull() | (F.col("user") == CLOSING))
    rows = events.where(known).select(
        *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys], F.coalesce("id", F.lit(-1).cast("long")).alias("id"), micros(F.col("ts")).alias("t"),
        F.when(connect, CONNECT).otherwise(OTHER).alias("c"), event_time(F.col("ts")).alias("__at"),
    ).withWatermark("__at", delay)
    names = [f"k{i}" for i in range(len(keys))]

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: dict[tuple, tuple[int, int]] = {}
        waiting: dict[tuple, list[tuple[int, int, int]]] = {}
        if state.exists:
            *held, last_t, last_c, at, t, ids, c = state.get
            places = list(zip(*held))
            last = {place: (a, b) for place, a, b in zip(places, last_t, last_c) if a is not None}
            for k, *row in zip(at, t, ids, c):
                waiting.setdefault(places[k], []).append(tuple(row))
        for part in parts:
            for place, *row in zip(zip(*[part[k] for k in keys]), part["t"].tolist(), part["id"].tolist(), part["c"].tolist()):
                waiting.setdefault(place, []).append(tuple(row))
        passed = state.getCurrentWatermarkMs()
        out, open_, due = [], [], []
        for place in {**last, **waiting}:
            rest = sorted(waiting.get(place, ()))
            n = sum(row[0] < passed * 1000 for row in rest)
            kept, end = kept_in_order(rest[:n], last.get(place), rule)
            rest = rest[n:]
            if rest or (end is not None and end[0] + rule.far >= passed * 1000):
                open_.append((place, end, rest))
                due.append(rest[0][0] if rest else end[0] + rule.far)
            if place[0] != CLOSING:
                out += [(*place, row) for row in kept]
        if open_:
            left = [(k, *row) for k, (_, _, rest) in enumerate(open_) for row in rest]
            state.update((
                *[[place[i] for place, _, _ in open_] for i in range(len(keys))],
                [end and end[0] for _, end, _ in open_], [end and end[1] for _, end, _ in open_], *[[row[i] for row in left] for i in range(4)],
            ))
            state.setTimeoutTimestamp(max(min(due) // 1000 + 1, passed + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[*keys, "id"])

    types = {f.name: f.dataType for f in events.schema.fields}
    out = T.StructType([*[T.StructField(k, types[k]) for k in keys], T.StructField("id", T.LongType())])
    held = ", ".join(f"{name} array<{types[k].simpleString()}>" for name, k in zip(names, keys))
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    return dealt.groupBy("__bucket").applyInPandasWithState(step, out, f"{held}, {_KNOWN}", "append", GroupStateTimeout.EventTimeTimeout)
