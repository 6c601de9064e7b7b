"""Nearest neighbours by inner product: lists of near vectors, scanned a few columns at a time.

Vectors get one more component that makes the largest inner product the smallest distance, are
rotated at random and dealt into lists around centres. In a probed list, distances are
summed over blocks of columns; a hypothesis test on the part seen so far drops a candidate
that will not be among the nearest. What is left is scored exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.batches import group_starts, whole_groups
from riskloom.plans.materialise import stored

NEAREST = 20
# Bounds of the fit: sampled vectors (smallest hashes of their id) and lists.
SAMPLE_ROWS, MOST_LISTS, LIST_ROWS = 16_384, 4096, 256
# Share of the nearest rows that the probed lists must hold, measured on that many sampled queries.
LIST_RECALL, TRIAL_QUERIES = 0.98, 256
# Candidates and queries of one job, columns added at a time, candidates scanned at a time.
JOB_ROWS, JOB_QUERIES = 4096, 2048
COLUMNS, CHUNK = 16, 512
# Queries whose lists one task finds.
PROBED_QUERIES = 1024
# Queries whose nearest rows a task holds before it passes them on.
HELD_QUERIES = 100_000
# Strength of the test: the chance of a wrong drop falls as exp(-c * STRICTNESS^2).
STRICTNESS = 2.1
JOB = ["list", "part", "turn"]


@dataclass(frozen=True)
class ListIndex:
    """Rotation of the lengthened vectors, their largest norm, the centres of the lists, lists to probe."""

    rotation: np.ndarray
    norm: float
    centres: np.ndarray
    probes: int = 1

    def rotated(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Lengthened and rotated vectors in single precision."""
        room = 0 * vectors[:, 0] if queries else np.sqrt(np.maximum(self.norm ** 2 - (vectors ** 2).sum(1), 0))
        return (np.column_stack([vectors, room]) @ self.rotation).astype(np.float32)

    def distances(self, rotated: np.ndarray) -> np.ndarray:
        """Squared distances to the centres, less each vector's own square."""
        return (self.centres ** 2).sum(1) - 2 * rotated @ self.centres.T


def _usable(vector: Column) -> Column:
    """Not null, not zero, every component there and finite."""
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (key, vector of doubles) that take part.

    Null and zero vectors, and those with a null or non-finite component, take no part, nor do
    rows without a key.
    """
    return vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("key").isNotNull() & _usable(F.col("vector"))
    )


def _centres(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds from evenly drawn rows; empty ones stay where they were."""
    rng = np.random.default_rng(11)
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=lists)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres).astype(np.float32)
    return centres


def probes_needed(index: ListIndex, x: np.ndarray, nearest: int) -> int:
    """Lists to probe so that they hold ``LIST_RECALL`` of the nearest sampled rows to sampled queries.

    Neighbours in a sample are farther away than among all rows, so this errs on the safe side.
    """
    q = x[:: max(1, len(x) // TRIAL_QUERIES)][:TRIAL_QUERIES]
    score = q @ x.T
    k = min(nearest + 1, len(x))
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    lists = index.distances(index.rotated(x)).argmin(1)
    place = index.distances(index.rotated(q, True)).argsort(1).argsort(1)
    ranks = np.sort(np.take_along_axis(place, lists[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(LIST_RECALL * len(ranks))))]) + 1


def fit_lists(
    rows: DataFrame, width: int, n_rows: int, nearest: int = NEAREST, list_rows: int = LIST_ROWS
) -> ListIndex:
    """Index fitted on at most ``SAMPLE_ROWS`` rows; the largest norm is that of all rows."""
    norm = rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).select("key", "vector").toArrow()
    x = np.asarray(sample.column("vector").combine_chunks().flatten()).reshape(-1, width)
    x = x[np.lexsort((x[:, 0], np.asarray(sample.column("key"))))]
    square = np.random.default_rng(7).standard_normal((width + 1, width + 1))
    rotation = np.linalg.qr(square)[0]
    bare = ListIndex(rotation, norm * (1 + 1e-12), np.zeros((1, width + 1), np.float32))
    lists = max(1, min(MOST_LISTS, n_rows // list_rows, len(x) // 8))
    index = ListIndex(rotation, bare.norm, _centres(bare.rotated(x), lists))
    return replace(index, probes=probes_needed(index, x, nearest))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, width)


def _listed(rows: DataFrame, index: ListIndex, width: int) -> DataFrame:
    """key, vector and the list of every row."""
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                near = sent.value.distances(sent.value.rotated(_matrix(part.column(1), width))).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near, pa.int32())], ["key", "vector", "list"])

    return rows.select("key", "vector").mapInArrow(batches, "key long, vector array<double>, list int")


def _probed(queries: DataFrame, index: ListIndex, sizes: dict[int, int], nearest: int, width: int) -> DataFrame:
    """key, vector and list of every query, once per list it looks into.

    The nearest ``index.probes`` lists, and further ones until they hold four times the rows asked for.
    """
    sent = queries.sparkSession.sparkContext.broadcast((index, sizes))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            found, held = sent.value
            order = found.distances(found.rotated(_matrix(part.column(1), width), True)).argsort(1, kind="stable")
            counts = np.array([held.get(k, 0) for k in range(len(found.centres))])
            before = np.cumsum(counts[order], axis=1) - counts[order]
            row, place = np.nonzero((before < 4 * nearest) | (np.arange(order.shape[1]) < found.probes))
            yield pa.RecordBatch.from_arrays(
                [c.take(pa.array(row)) for c in part.columns] + [pa.array(order[row, place], pa.int32())],
                ["key", "vector", "list"],
            )

    return queries.select("key", "vector").mapInArrow(batches, "key long, vector array<double>, list int")


def scan_list(x: np.ndarray, q: np.ndarray, nearest: int, known: np.ndarray | None = None) -> list[np.ndarray]:
    """Positions in ``x`` of what may be among the ``nearest`` rows to each row of ``q``.

    Rotated vectors; ``known`` limits come from lists scanned before. The first candidates are compared whole and give each query a limit,
    the distance of its worst kept candidate. Others add ``COLUMNS`` columns at a time and go when the
    distance that the part seen stands for exceeds the limit by more than its likely error.
    """
    width = x.shape[1]
    limits = np.full(len(q), np.inf, np.float32) if known is None else known.astype(np.float32)
    kept_d = [np.zeros(0, np.float32)] * len(q)
    kept_i = [np.zeros(0, np.int64)] * len(q)
    for begin in range(0, len(x), CHUNK):
        part = x[begin:begin + CHUNK]
        rows, cols = np.divmod(np.arange(len(q) * len(part)), len(part))
        total = np.zeros(len(rows), np.float32)
        for first in range(0, width, COLUMNS):
            at = slice(first, min(first + COLUMNS, width))
            if len(rows) == len(q) * len(part):
                a, b = q[:, at], part[:, at]
                step = ((a ** 2).sum(1)[:, None] + (b ** 2).sum(1) - 2 * a @ b.T).ravel()
            else:
                gap = q[rows, at] - part[cols, at]
                step = np.einsum("ij,ij->i", gap, gap)
            total = total + step
            seen = at.stop
            slack = (1 + STRICTNESS / np.sqrt(seen)) ** 2 if seen < width else 1 + 1e-4
            alive = total * (width / seen) <= limits[rows] * slack + 1e-5
            rows, cols, total = rows[alive], cols[alive], total[alive]
        cuts = np.searchsorted(rows, np.arange(len(q) + 1))
        for k in range(len(q)):
            a, b = cuts[k], cuts[k + 1]
            if a == b:
                continue
            d = np.concatenate([kept_d[k], total[a:b]])
            i = np.concatenate([kept_i[k], cols[a:b] + begin])
            # One more than asked for, as a query may meet itself.
            if len(d) > nearest + 1:
                limits[k] = min(limits[k], np.partition(d, nearest)[nearest])
                near = d <= limits[k] * (1 + 1e-4) + 1e-5
                d, i = d[near], i[near]
            kept_d[k], kept_i[k] = d, i
    return kept_i


class _Best:
    """The nearest rows found so far by one task, for a bounded number of queries."""

    def __init__(self, nearest: int, norm: float):
        self.nearest, self.norm = nearest, norm
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def limit(self, name: int, square: float) -> float:
        """Squared distance that a row must not exceed to be among the nearest."""
        held = self.found.get(name)
        if held is None or len(held[0]) < self.nearest:
            return np.inf
        return max(0.0, square + self.norm ** 2 - 2 * held[1][-1])

    def add(self, name: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge rows; ties go to the smaller id."""
        if name in self.found:
            ids, scores = (np.concatenate(pair) for pair in zip(self.found[name], (ids, scores)))
        best = np.lexsort((ids, -scores))[:self.nearest]
        self.found[name] = ids[best], scores[best]

    def emptied(self) -> Iterator[pa.RecordBatch]:
        """All rows held, and none after that."""
        names = list(self.found)
        for begin in range(0, len(names), 4096):
            some = names[begin:begin + 4096]
            rows = [self.found[n] for n in some]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(some, [len(r[0]) for r in rows])), pa.array(np.concatenate([r[0] for r in rows])),
                pa.array(np.concatenate([r[1] for r in rows])),
            ], ["query_id", "vec_id", "score"])
        self.found.clear()


def _scanned(index_sent, width: int, nearest: int):
    """Job rows to the nearest rows of each query among the lists of the task."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_sent.value
        best = _Best(nearest, index.norm)
        for whole in whole_groups(parts, JOB, 1):
            starts = group_starts(whole, JOB)
            for begin, end in zip(starts, np.append(starts[1:], whole.num_rows)):
                job = whole.slice(begin, end - begin)
                asks = job.column("asks").to_numpy()
                keys, vectors = job.column("key").to_numpy(), _matrix(job.column("vector"), width)
                x, ids, q, names = vectors[~asks], keys[~asks], vectors[asks], keys[asks]
                if len(q) == 0 or len(x) == 0:
                    continue
                known = np.array([best.limit(int(n), s) for n, s in zip(names, (q ** 2).sum(1))])
                found = scan_list(index.rotated(x), index.rotated(q, True), nearest, known)
                for k, near in enumerate(found):
                    near = near[ids[near] != names[k]]
                    if len(near):
                        best.add(int(names[k]), ids[near], (x[near] * q[k]).sum(axis=1))
            if len(best.found) > HELD_QUERIES:
                yield from best.emptied()
        yield from best.emptied()

    return batches


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding",
    nearest: int = NEAREST, list_rows: int = LIST_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` rows of ``vectors`` found for each query.

    Rows with the query's own key are not candidates. Ties go to the smaller key. Keys are
    whole numbers; a repeated key is a candidate each time, and as a query once, with its smallest
    vector. A query is compared with the vectors of its own dimension; each dimension has an index of its own. Lists and
    their queries are cut into jobs of bounded size, so a list with a third of all rows is shared by many
    tasks. An empty side gives no rows.
    """
    spark = vectors.sparkSession
    size = F.size("vector")
    rows = stored(usable_vectors(vectors, key, vector).withColumn("width", size), "vectors")
    asked = stored(
        usable_vectors(queries, key, vector).groupBy("key").agg(F.min(F.struct(size, "vector")).alias("v"))
        .select("key", "v.vector", F.size("v.vector").alias("width")), "vectors-asked",
    )
    # A row per dimension.
    held = {r["width"]: r["count"] for r in rows.groupBy("width").count().collect()}
    turned = {r["width"]: r["count"] for r in asked.groupBy("width").count().collect()}
    best = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in sorted(set(held) & set(turned)):
        mine = F.col("width") == width
        best = best.unionByName(_nearest_of_width(
            rows.where(mine).drop("width"), held[width], asked.where(mine).drop("width"), turned[width], width, nearest, list_rows
        ))
    return best


def _nearest_of_width(
    rows: DataFrame, n_rows: int, asked: DataFrame, n_asked: int, width: int, nearest: int, list_rows: int
) -> DataFrame:
    """The nearest rows to each query, all of one dimension."""
    spark = rows.sparkSession
    index = fit_lists(rows, width, n_rows, nearest, list_rows)
    listed = stored(_listed(rows, index, width), "vectors-listed")
    # At most MOST_LISTS counts.
    sizes = {r[0]: r[1] for r in listed.groupBy("list").count().collect()}
    spread_asks = asked.repartition(-(-n_asked // PROBED_QUERIES), F.xxhash64("key"))
    probed = stored(_probed(spread_asks, index, sizes, nearest, width), "vectors-probed")
    wanted = {r[0]: r[1] for r in probed.groupBy("list").count().collect()}
    cut = F.broadcast(spark.createDataFrame(
        [(k, -(-n // JOB_ROWS), -(-wanted[k] // JOB_QUERIES)) for k, n in sizes.items() if k in wanted],
        "list int, parts int, turns int",
    ))
    spread = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = probed.join(cut, "list").withColumn("turn", spread(F.col("turns"))).withColumn("part", every(F.col("parts")))
    holds = listed.join(cut, "list").withColumn("part", spread(F.col("parts"))).withColumn("turn", every(F.col("turns")))
    columns = [*JOB, "key", "vector"]
    jobs = asks.select(*columns, F.lit(True).alias("asks")).unionByName(holds.select(*columns, F.lit(False).alias("asks")))
    found = jobs.repartition(*JOB).sortWithinPartitions(*JOB).mapInArrow(
        _scanned(spark.sparkContext.broadcast(index), width, nearest), "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select(
        "query_id", "rank", "vec_id", "score"
    )
