"""Similarity join on word shingles: MinHash candidates, Bayesian pruning, exact check.

Texts with equal shingles are one node. Nodes that share a band of MinHash values meet in a
bucket; large buckets are cut into blocks, and every pair of blocks is a job of
bounded size. In a job, pairs are compared a few MinHash values at a time and dropped
once the posterior probability of reaching the threshold is below a tolerance; the rest
are checked on the shingles themselves. A pair is handled in the first band it shares only.
Jobs run twice: on sketches alone, to name the nodes of surviving pairs, and for these with their
shingles, where the same pairs survive and are checked. Pairs exist a bounded number at a time and are never
stored; jobs return a row per node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.batches import binary_numbers, bounded_rows, group_starts, whole_groups
from riskloom.llm.components import components
from riskloom.llm.shingles import BAND_ROWS, BANDS, HASHES, minhashes, set_digest, shingles
from riskloom.llm.spread import seen_filter, with_seen
from riskloom.plans.materialise import stored

THRESHOLD = 0.8
# With six steps it costs less than 2e-6 of the pairs at the threshold (see ``lost_share``).
TOLERANCE = 3e-7
# MinHash values compared at a time.
STEP = 16
# Shingles (8 bytes each) and nodes that a block holds on average; a job holds two blocks.
BLOCK_SHINGLES, BLOCK_NODES = 1 << 20, 1 << 11
_PAIRS = 1 << 16
JOB = ["band", "bucket", "low", "high"]


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> np.ndarray:
    """Fewest equal MinHash values, after each step, that keep a pair.

    With an even prior, m equal values of n give the posterior density s^m (1-s)^(n-m); a
    pair goes when the mass at or above the threshold is below the tolerance.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    above = s >= threshold
    least = []
    for n in range(step, HASHES + 1, step):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        mass = np.exp(log - log.max(axis=1, keepdims=True))
        least.append(int(np.argmax(mass[:, above].sum(1) / mass.sum(1) >= tolerance)))
    return np.array(least)


def _pairs(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), a < b, of all pairs inside groups, a bounded number at a time.

    ``ends`` holds for each row the end of its group.
    """
    partners = ends - np.arange(len(ends)) - 1
    done = np.concatenate([[0], np.cumsum(partners)])
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(done, done[first] + _PAIRS, "right")) - 1)
        counts = partners[first:last]
        a = np.repeat(np.arange(first, last), counts)
        b = a + 1 + np.arange(len(a)) - np.repeat(done[first:last] - done[first], counts)
        if len(a):
            yield a, b
        first = last


def lost_share(similarity: float, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> float:
    """Share of the pairs of a similarity that are dropped at some step or share no band."""
    once = [comb(STEP, k) * similarity ** k * (1 - similarity) ** (STEP - k) for k in range(STEP + 1)]
    alive, lost = np.array([1.0]), (1 - similarity ** BAND_ROWS) ** BANDS
    for least in least_matches(threshold, tolerance):
        alive = np.convolve(alive, once)
        lost += alive[:least].sum()
        alive[:least] = 0
    return float(lost)


def _survivors(whole: pa.Table, threshold: float, keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (a, b), a < b, of the same job that survive the comparison, a bounded number at a time."""
    starts = group_starts(whole, JOB)
    ends = np.append(starts[1:], whole.num_rows)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    values = binary_numbers(whole.column("sketch"), "<u2").reshape(-1, HASHES)
    bands = np.ascontiguousarray(values).view("<u8")
    n = whole.column("n").to_numpy()
    block, band = whole.column("block").to_numpy(), whole.column("band").to_numpy()
    apart = whole.column("low").to_numpy() != whole.column("high").to_numpy()
    for a, b in _pairs(ends[group]):
        ok = ~(apart[a] & (block[a] == block[b]))
        ok &= np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
        a, b = a[ok], b[ok]
        ok = (bands[a] == bands[b]).argmax(axis=1) == band[a]
        a, b = a[ok], b[ok]
        equal = np.zeros(len(a), np.int64)
        for k, least in enumerate(keep):
            at = slice(k * STEP, (k + 1) * STEP)
            equal += (values[a, at] == values[b, at]).sum(axis=1)
            ok = equal >= least
            a, b, equal = a[ok], b[ok], equal[ok]
        if len(a):
            yield a, b


def _candidates(threshold: float, tolerance: float) -> Callable:
    """Job rows to those of nodes with a surviving pair, without their sketches."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = least_matches(threshold, tolerance)
        for whole in whole_groups(parts, JOB, 2 * BLOCK_NODES):
            used = np.zeros(whole.num_rows, bool)
            for a, b in _survivors(whole, threshold, keep):
                used[a] = used[b] = True
            if used.any():
                rows = whole.select([*JOB, "block", "node"]).filter(pa.array(used))
                yield from rows.combine_chunks().to_batches()

    return batches


class _Sets:
    """Shingle sets of some rows, and the sizes of their common parts, one row against many."""

    def __init__(self, packed: list[bytes]):
        self.sizes = np.array([len(p) // 8 for p in packed])
        _, self.codes = np.unique(np.frombuffer(b"".join(packed), "<u8"), return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.marked = np.zeros(int(self.codes.max(initial=0)) + 1, bool)

    def common(self, a: int, b: np.ndarray) -> np.ndarray:
        """Shingles that row ``a`` shares with each of the rows ``b``."""
        own = self.codes[self.at[a]:self.at[a + 1]]
        self.marked[own] = True
        low, high = int(b.min()), int(b.max()) + 1
        if len(b) * 2 > high - low:
            hits = self.marked[self.codes[self.at[low]:self.at[high]]].astype(np.int64)
            shared = np.add.reduceat(hits, self.at[low:high] - self.at[low])[b - low]
        else:
            shared = np.array([np.count_nonzero(self.marked[self.codes[self.at[k]:self.at[k + 1]]]) for k in b])
        self.marked[own] = False
        return shared


def _check(threshold: float, tolerance: float) -> Callable:
    """Job rows with sketches and shingles to a row per linked node: root, texts and documents linked."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = least_matches(threshold, tolerance)
        for whole in whole_groups(parts, JOB, BLOCK_NODES):
            sets, copies = _Sets(whole.column("shingles").to_pylist()), whole.column("copies").to_numpy()
            texts, docs = np.zeros(whole.num_rows, np.int64), np.zeros(whole.num_rows, np.int64)
            # Rows of a class point to an earlier one of it, the first to itself.
            root = list(range(whole.num_rows))

            def top(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for firsts, seconds in _survivors(whole, threshold, keep):
                heads = np.flatnonzero(np.diff(firsts, prepend=-1))
                for begin, end in zip(heads, np.append(heads[1:], len(firsts))):
                    a, b = int(firsts[begin]), seconds[begin:end]
                    shared = sets.common(a, b)
                    linked = b[shared >= threshold * (sets.sizes[a] + sets.sizes[b] - shared) - 1e-9]
                    texts[a] += len(linked)
                    docs[a] += copies[linked].sum()
                    texts[linked] += 1
                    docs[linked] += copies[a]
                    for k in linked.tolist():
                        x, y = sorted((top(a), top(k)))
                        root[y] = x
            used = np.flatnonzero(texts)
            if len(used):
                nodes = whole.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([
                    nodes.take(pa.array(used)), nodes.take(pa.array([top(k) for k in used.tolist()])),
                    pa.array(texts[used]), pa.array(docs[used]),
                ], ["node", "root", "texts", "docs"])

    return batches


def _sketches(key: str, with_sets: bool) -> Callable:
    """Rows (key, mark, text) to node, number of shingles and sketch (or the shingles)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_rows(parts, 2):
            sets = [shingles(t) for t in part.column(2).to_pylist()]
            nodes = pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary())
            if with_sets:
                last = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
            else:
                last = pa.array([minhashes(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), nodes, pa.array([len(s) for s in sets], pa.int32()), last],
                [key, "mark", "node", "n", "shingles" if with_sets else "sketch"],
            )

    return batches


def similar_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE, block_shingles: int = BLOCK_SHINGLES, block_nodes: int = BLOCK_NODES,
) -> DataFrame:
    """One row per row of ``docs``: key, mark, class_id, links, linked_texts, copies, stays.

    ``class_id`` is the smallest key that the row is linked to, directly or through others;
    ``links`` counts the other rows with a similarity of at least ``threshold``;
    ``linked_texts`` those among them with other shingles, each set of shingles once; ``copies`` the rows
    with the same shingles, this one included; ``stays`` marks the row that
    stands for its class; ``mark`` is a hash of the text. Texts without a word (null, empty,
    signs only) link to nothing: each is its own class. A link at the threshold is lost with a
    probability of ``lost_share``, below 6e-6: 3.3e-6 without a shared band, the rest dropped by a step.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("__text"))
    rows = stored(
        source.mapInArrow(_sketches("key", False), f"key {kind}, mark long, node binary, n int, sketch binary"),
        "jaccard-rows",
    )
    nodes = stored(
        rows.where("node is not null").groupBy("node").agg(
            F.min(F.struct("key", "mark")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"),
            F.min("sketch").alias("sketch"),
        ), "jaccard-nodes",
    )
    cut = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(
        k.alias("band"), F.substring(F.col("sketch"), k * 8 + 1, F.lit(8)).alias("bucket")
    ))
    banded = nodes.select("node", "n", F.explode(cut).alias("b")).select("b.band", "b.bucket", "node", "n")
    shared = banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("total") / block_shingles), F.ceil(F.col("m") / block_nodes))
    members = banded.join(shared, ["band", "bucket"]).withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks"))
    ).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    jobs = members.select(
        "band", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "node", "n",
    ).join(nodes.select("node", "sketch"), "node")
    job_types = "band int, bucket binary, low long, high long, block long, node binary"
    kept = stored(
        jobs.repartition(*JOB).sortWithinPartitions(*JOB).mapInArrow(_candidates(threshold, tolerance), job_types),
        "jaccard-candidates",
    )
    reps = stored(kept.select("node").distinct().join(nodes, "node"), "jaccard-reps")
    # Texts are not moved: rows that a filter of the wanted names may hold give their shingles, and only those of
    # wanted nodes meet the jobs.
    names = stored(seen_filter(reps.select(F.col("rep.key").alias("__k"), F.col("rep.mark").alias("__m")), F.xxhash64("__k", "__m")), "jaccard-wanted")
    sets = (
        with_seen(source, F.xxhash64("key", "mark"), "__hit", names).where("__hit").select("key", "mark", "__text")
        .mapInArrow(_sketches("key", True), f"key {kind}, mark long, node binary, n int, shingles binary")
        .where("node is not null").select("node", "shingles")
        .join(reps.select("node"), "node", "left_semi").dropDuplicates(["node"])
    )
    linked = stored(
        kept.join(reps.select("node", "n", "sketch", "copies"), "node").join(sets, "node")
        .select(*JOB, "block", "node", "n", "sketch", "copies", "shingles")
        .repartition(*JOB).sortWithinPartitions(*JOB)
        .mapInArrow(_check(threshold, tolerance), "node binary, root binary, texts long, docs long"),
        "jaccard-links",
    )
    found = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = linked.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    placed = nodes.select("node", "rep", "copies").join(counts, "node", "left").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    heads = placed.groupBy("component").agg(F.min("rep").alias("head"))
    named = placed.join(heads, "component").select(
        "node", "copies", "head", F.coalesce("texts", F.lit(0)).cast("long").alias("texts"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).cast("long").alias("docs"),
    )
    alone = F.col("copies").isNull()
    return rows.select("key", "mark", "node").join(named, "node", "left").select(
        F.col("key").alias(key), "mark",
        F.when(alone, F.col("key")).otherwise(F.col("head.key")).alias("class_id"),
        F.coalesce("docs", F.lit(0).cast("long")).alias("links"),
        F.coalesce("texts", F.lit(0).cast("long")).alias("linked_texts"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        (alone | (F.col("key").eqNullSafe(F.col("head.key")) & F.col("mark").eqNullSafe(F.col("head.mark")))).alias("stays"),
    )


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all their columns.

    Repeated rows stand together: they are one key and text. Only rows that a filter of the dropped names may
    hold are moved to be told apart exactly; all others stay where they are.
    """
    gone = stored(similar_documents(docs, key, text).where("not stays").select(
        F.col(key).alias("__k"), F.col("mark").alias("__m")
    ).distinct(), "jaccard-dropped")
    names = stored(seen_filter(gone, F.xxhash64("__k", "__m")), "jaccard-dropped-filter")
    rows = docs.withColumn("__mark", F.xxhash64(F.col(text)))
    told = with_seen(rows, F.xxhash64(key, "__mark"), "__hit", names)
    some = told.where("__hit")
    same = some[key].eqNullSafe(F.col("__k")) & (some["__mark"] == F.col("__m"))
    return told.where("not __hit").select(*docs.columns).unionByName(some.join(gone, same, "left_anti").select(*docs.columns))
