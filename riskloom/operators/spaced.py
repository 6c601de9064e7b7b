"""The "last kept" rule: a row is dropped or kept by its distance to the last row that was *kept*.

Comparing neighbours is wrong for such a rule, and walking a key's rows in order puts a busy key in one
task. Two facts make it a Spark job:

* after a silence longer than the rule reaches, or at the next key, the next row is always kept. So all rows,
  sorted by key and time, are one sequence in which distances beyond the reach are alike, and the state is the
  age and kind of the row kept last;
* which row is kept next depends on the state alone, so a slice of the sequence is a map from the
  state before it to the state after it. Maps are composed: ``FAN`` slices become one map, level by level, and
  the states are handed down again. No task holds more than ``FAN`` maps or one slice of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.calendar import micros
from riskloom.operators.cells import CELL, sliced, whole_cells
from riskloom.operators.ordering import SLICE_ROWS, global_rank
from riskloom.plans.materialise import stored

CONNECT, OTHER = 1, 0
# Maps that are composed at a time.
FAN = 64

_MAP = "first_key string, first_t long, last_key string, last_t long, span long, heads binary"
_MAP_COLUMNS = ["first_key", "first_t", "last_key", "last_t", "span", "heads"]


@dataclass(frozen=True)
class Rule:
    """Repeats within ``duplicate`` of a kept row of their kind go; others within less than ``bounce`` of a kept connect."""

    duplicate: int
    bounce: int

    @property
    def far(self) -> int:
        """A distance at which no row is dropped any more; larger ones count as this."""
        return max(self.duplicate, self.bounce) + 1

    def dropped(self, gap: np.ndarray, kind: np.ndarray, last: int) -> np.ndarray:
        """Rows of ``kind`` that go at a distance of ``gap`` from a kept row of kind ``last``."""
        out = (kind == last) & (gap <= self.duplicate)
        return out | (kind == OTHER) & (gap < self.bounce) if last == CONNECT else out


@dataclass
class SliceMap:
    """What a slice does to the state (age and kind of the row kept last).

    ``heads`` has a row for each row that may be the first one kept: its distance from the first row, its kind,
    and age and kind of the row kept last if it is. ``span`` is the distance from the first to the last row.
    """

    first: tuple[str, int]
    last: tuple[str, int]
    span: int
    heads: np.ndarray

    def after(self, state: tuple[int, int], rule: Rule) -> tuple[int, int]:
        """The state behind the slice; ages count from its first row before it and from its last row behind it."""
        age, kind = state
        free = np.flatnonzero(~rule.dropped(self.heads[:, 0] + age, self.heads[:, 1], kind))
        if len(free):
            return int(self.heads[free[0], 2]), int(self.heads[free[0], 3])
        return min(age + self.span, rule.far), kind

    def entered(self, before: SliceMap, state: tuple[int, int], rule: Rule) -> tuple[int, int]:
        """The state before this slice, from the one behind the slice before it."""
        return min(state[0] + self.gap(before, rule), rule.far), state[1]

    def gap(self, before: SliceMap, rule: Rule) -> int:
        """Distance from the last row of the slice before to this one's first."""
        return min(self.first[1] - before.last[1], rule.far) if self.first[0] == before.last[0] else rule.far

    def then(self, later: SliceMap, rule: Rule) -> SliceMap:
        """This map followed by that of the next slice."""
        heads = self.heads.copy()
        for row in heads:
            row[2:] = later.after(later.entered(self, (int(row[2]), int(row[3])), rule), rule)
        shift = min(self.span + later.gap(self, rule), rule.far)
        if self.span < rule.far:
            # A state may outlast this slice whole: the first kept row can be one of the next, up to one that always is.
            moved = later.heads.copy()
            moved[:, 0] += shift
            heads = np.concatenate([heads, moved[:int((moved[:, 0] < rule.far).sum()) + 1]])
        return SliceMap(self.first, later.last, min(shift + later.span, rule.far), _shortened(heads))

    def fields(self) -> tuple:
        """Values of the ``_MAP_COLUMNS``."""
        return (*self.first, *self.last, self.span, self.heads.astype("<i8").tobytes())


def _map_of(row) -> SliceMap:
    return SliceMap(
        (row.first_key, int(row.first_t)), (row.last_key, int(row.last_t)), int(row.span),
        np.frombuffer(row.heads, "<i8").reshape(-1, 4),
    )


def _shortened(heads: np.ndarray) -> np.ndarray:
    """Of neighbours that lead to the same end, the latest of each kind answers for all."""
    if len(heads) < 2:
        return heads
    run = np.concatenate([[0], np.cumsum((heads[1:, 2:] != heads[:-1, 2:]).any(axis=1))])
    name = run * 2 + heads[:, 1]
    _, last = np.unique(name[::-1], return_index=True)
    return heads[np.sort(len(heads) - 1 - last)]


def clock(keys: pa.ChunkedArray, t: np.ndarray, rule: Rule) -> np.ndarray:
    """Positions of sorted rows: distances beyond the reach, and between keys, count as ``far``."""
    codes = pc.dictionary_encode(keys.combine_chunks()).indices.to_numpy()
    steps = np.minimum(np.diff(t), rule.far)
    steps[codes[1:] != codes[:-1]] = rule.far
    return np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)


def successors(p: np.ndarray, kind: np.ndarray, rule: Rule) -> np.ndarray:
    """For each sorted row, the row kept next if it is kept; ``len(p)`` when none is."""
    n = len(p)
    nearest = np.full(n, n)
    for wanted in (OTHER, CONNECT):
        places = np.flatnonzero(kind == wanted)
        if not len(places):
            continue
        # First place of this kind whose distance is no longer dropped.
        following = np.searchsorted(places, np.arange(n), side="right")
        same = np.searchsorted(p[places], p + rule.duplicate, side="right")
        other = following
        if wanted == OTHER:
            other = np.maximum(other, np.searchsorted(p[places], p + rule.bounce, side="left"))
        first = np.maximum(np.where(kind == wanted, same, other), following)
        nearest = np.minimum(nearest, np.append(places, n)[first])
    return nearest


def slice_map(keys: pa.ChunkedArray, t: np.ndarray, kind: np.ndarray, rule: Rule) -> SliceMap:
    """The map of one slice of sorted rows."""
    p = clock(keys, t, rule)
    n = len(p)
    after = successors(p, kind, rule)
    last = np.where(after < n, after, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    count = int(np.searchsorted(p, rule.far, side="left")) + 1
    ends = last[:count]
    heads = np.column_stack([p[:count], kind[:count], np.minimum(p[-1] - p[ends], rule.far), kind[ends]]).astype(np.int64)
    return SliceMap(
        (keys[0].as_py(), int(t[0])), (keys[n - 1].as_py(), int(t[-1])), int(min(p[-1], rule.far)), _shortened(heads)
    )


def kept_rows(keys: pa.ChunkedArray, t: np.ndarray, kind: np.ndarray, state: tuple[int, int], rule: Rule) -> np.ndarray:
    """Which rows of a slice are kept after ``state``."""
    p = clock(keys, t, rule)
    after = successors(p, kind, rule)
    kept = np.zeros(len(p), bool)
    reach = int(np.searchsorted(p, rule.far, side="left")) + 1
    free = np.flatnonzero(~rule.dropped(p[:reach] + state[0], kind[:reach], state[1]))
    at = int(free[0]) if len(free) else len(p)
    while at < len(p):
        kept[at] = True
        at = int(after[at])
    return kept


def _states(maps: DataFrame, rule: Rule, fan: int) -> DataFrame:
    """(cell, age, kind) before each slice, by composing the maps level by level and handing states down."""
    levels, n = [maps], maps.count()
    while n > fan:
        ranked = global_rank(levels[-1].select(CELL), [F.col(CELL)], "__place")
        up = F.floor((F.col("__place") - 1) / fan).cast("long")
        levels[-1] = stored(levels[-1].join(ranked.select(CELL, up.alias("__up")), CELL), "rule-maps")

        def compose(part: pd.DataFrame) -> pd.DataFrame:
            whole = None
            for row in part.sort_values(CELL)[_MAP_COLUMNS].itertuples(index=False):
                whole = _map_of(row) if whole is None else whole.then(_map_of(row), rule)
            return pd.DataFrame([(part["__up"].iloc[0], *whole.fields())], columns=[CELL, *_MAP_COLUMNS])

        levels.append(stored(
            levels[-1].groupBy("__up").applyInPandas(compose, f"{CELL} long, {_MAP}"), "rule-maps"
        ))
        n = -(-n // fan)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(CELL)
        # Age and kind before the group; nothing kept yet counts as far away.
        state = (int(part["__age"].iloc[0]), int(part["__kind"].iloc[0]))
        out, before = [], None
        for cell, row in zip(part[CELL], part[_MAP_COLUMNS].itertuples(index=False)):
            now = _map_of(row)
            if before is not None:
                state = now.entered(before, state, rule)
            out.append((cell, *state))
            state, before = now.after(state, rule), now
        return pd.DataFrame(out, columns=[CELL, "age", "kind"])

    def handed(children: DataFrame) -> DataFrame:
        return children.groupBy("__up").applyInPandas(walk, f"{CELL} long, age long, kind long")

    top = levels.pop()
    states = handed(top.withColumns({
        "__up": F.lit(0).cast("long"), "__age": F.lit(rule.far).cast("long"), "__kind": F.lit(CONNECT).cast("long")
    }))
    while levels:
        above = states.select(F.col(CELL).alias("__up"), F.col("age").alias("__age"), F.col("kind").alias("__kind"))
        states = handed(levels.pop().join(above, "__up"))
    return states


def spaced_rows(
    rows: DataFrame, keys: Sequence[str], connect: Column, rule: Rule, most: int = SLICE_ROWS, fan: int = FAN
) -> DataFrame:
    """The rows that the rule keeps, with all their columns.

    ``rows`` have a time ``ts``, keys that are not null, and ``id`` (a long), which identifies a row and orders
    equal times. Rows are cut into slices of at most ``most`` rows and move once more, to meet the states.
    """
    cut = sliced(
        rows.withColumns({
            "__k": F.to_json(F.struct(*keys)), "__t": micros(F.col("ts")), "__c": F.when(connect, CONNECT).otherwise(OTHER),
        }), keys, ("__t", "id"), most,
    )

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, part in whole_cells(parts):
            made = slice_map(part.column("__k"), part.column("__t").to_numpy(), part.column("__c").to_numpy(), rule)
            yield pa.RecordBatch.from_pylist([dict(zip([CELL, *_MAP_COLUMNS], (cell, *made.fields())))], map_schema)

    map_schema = pa.schema([
        (CELL, pa.int64()), ("first_key", pa.string()), ("first_t", pa.int64()), ("last_key", pa.string()),
        ("last_t", pa.int64()), ("span", pa.int64()), ("heads", pa.binary()),
    ])
    maps = stored(cut.select(CELL, "__k", "__t", "__c").mapInArrow(summed, f"{CELL} long, {_MAP}"), "rule-maps")
    states = _states(maps, rule, fan).select(CELL, F.col("age").alias("__age"), F.col("kind").alias("__kind"))
    # The state of a slice comes first among its rows.
    met = (
        cut.unionByName(states, allowMissingColumns=True).repartition(CELL)
        .sortWithinPartitions(CELL, F.col("__age").isNull(), *keys, "__t", "id")
    )
    names = rows.columns

    def replayed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in whole_cells(parts):
            state = part.column("__age")[0].as_py(), part.column("__kind")[0].as_py()
            part = part.slice(1)
            kept = kept_rows(
                part.column("__k"), part.column("__t").to_numpy(), part.column("__c").to_numpy(), state, rule
            )
            yield from part.select(names).filter(pa.array(kept)).combine_chunks().to_batches()

    return met.mapInArrow(replayed, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
