"""A Merkle manifest of a table, with nodes labelled by the leaf ranks they cover.

Leaves are ranked inside their tree; a node of level k covers the interval [low, high) of at most
``FANOUT ** k`` ranks. Ancestors are attached by containment of intervals, joined in buckets of
``HEIGHT`` levels: the key of a bucket is the tree and the interval ``HEIGHT`` levels up, so a bucket holds a
bounded number of nodes. Siblings are the nodes of a parent's interval less the node's own.
What lies above a bucket (its proof up to the root) is worked out on the far smaller table of bucket tops
and joined as one row a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.batches import group_starts, whole_groups
from riskloom.llm.exact import LOWER, UPPER
from riskloom.llm.spread import join_groups
from riskloom.operators.ordering import global_rank
from riskloom.plans.materialise import stored

FANOUT = 8
# Levels of a bucket: FANOUT ** HEIGHT members at most.
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3
TOP = "top"
BUCKET = ["tree", "bucket"]


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its length in bytes, a colon and the value."""
    parts = []
    for value in values:
        said = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tree_levels(leaves: DataFrame) -> list[DataFrame]:
    """Tables of nodes (tree, size, low, high, digest) by level, the leaves first.

    ``leaves``: tree, size (leaves of the tree), low (rank from 0) and digest. A level holds the trees in which the
    level below has several nodes; each level is written, and is an eighth of the one below.
    """
    deepest = leaves.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    levels = [leaves.select("tree", "size", "low", (F.col("low") + 1).alias("high"), "digest")]
    width = 1
    while width < deepest:
        run = F.floor(F.col("low") / (width * FANOUT)).cast("long")
        below = levels[-1].where(F.col("size") > width)
        levels.append(stored(
            below.groupBy("tree", "size", run.alias("run")).agg(
                F.min("low").alias("low"), F.max("high").alias("high"),
                F.array_sort(F.collect_list(F.struct("low", "digest"))).alias("kids"),
            ).select("tree", "size", "low", "high", F.sha2(F.array_join("kids.digest", ""), 256).alias("digest")),
            "merkle-level",
        ))
        width *= FANOUT
    return levels


def tree_roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, size, root): the one node left in each tree."""
    alone = [
        nodes.where((F.col("low") == 0) & (F.col("high") == F.col("size"))).select("tree", "size", F.lit(k).alias("level"), F.col("digest").alias("root"))
        for k, nodes in enumerate(levels)
    ]
    found = alone[0]
    for more in alone[1:]:
        found = found.unionByName(more)
    return found.select("tree", "size", "root")


def _steps(lows: np.ndarray, nodes: list[tuple[np.ndarray, np.ndarray, list[str]]]) -> list[list[tuple[int, int, int, int]]]:
    """For the members at ``lows``, the runs of siblings level by level.

    ``nodes`` holds lows, highs and digests of each level of the bucket, the members' level first. A run is
    (first sibling, own place, end, level) in the nodes of its level; the parent is the node of the next level whose
    interval contains the member.
    """
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in lows]
    for k in range(len(nodes) - 1):
        low, (above, ends, _) = nodes[k][0], nodes[k + 1]
        parent = np.searchsorted(above, lows, "right") - 1
        if len(above) == 0:
            break
        own = np.searchsorted(low, lows, "right") - 1
        first, end = np.searchsorted(low, above[parent]), np.searchsorted(low, ends[parent])
        for n, step in enumerate(zip(first.tolist(), own.tolist(), end.tolist())):
            found[n].append((*step, k))
    return found


def _pack(place: int, left: list[str], right: list[str]) -> bytes:
    """One level of a proof: own place, siblings, their digests."""
    return bytes([place, len(left) + len(right)]) + "".join(left + right).encode()


def _unpack(blob: bytes) -> list[tuple[str, str]]:
    """Levels of a proof as digests to the left and to the right."""
    out, at = [], 0
    while at < len(blob):
        place, n = blob[at], blob[at + 1]
        said = blob[at + 2:at + 2 + 64 * n].decode()
        out.append((said[:64 * place], said[64 * place:]))
        at += 2 + 64 * n
    return out


def _bucket_rows(parts: Iterator[pa.RecordBatch], first_level: int, height: int) -> Iterator[tuple]:
    """Each bucket: its rows, the rows of its members, their proofs inside it and the row of what lies above."""
    for whole in whole_groups(parts, BUCKET):
        starts = group_starts(whole, BUCKET)
        for begin, end in zip(starts, np.append(starts[1:], whole.num_rows)):
            rows = whole.slice(begin, end - begin)
            level = rows.column("level").to_numpy()
            low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
            digest = rows.column("digest").to_pylist()
            nodes = []
            for k in range(first_level, first_level + height + 1):
                at = np.flatnonzero(level == k)
                nodes.append((low[at], high[at], [digest[n] for n in at]))
            members = np.flatnonzero(level == first_level)
            above = int(np.flatnonzero(level == -1)[0])
            yield rows, members, nodes, _steps(low[members], nodes), above


def _chains(first_level: int, height: int) -> Callable:
    """Rows of buckets to (tree, low, proof) of their members, up to the root."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, members, nodes, steps, above in _bucket_rows(parts, first_level, height):
            rest = rows.column("proof")[above].as_py() or b""
            proofs = []
            for runs in steps:
                packed = [
                    _pack(own - first, nodes[k][2][first:own], nodes[k][2][own + 1:end]) for first, own, end, k in runs
                ]
                proofs.append(b"".join(packed) + rest)
            at = pa.array(members)
            yield pa.RecordBatch.from_arrays([
                rows.column("tree").combine_chunks().take(at), rows.column("low").combine_chunks().take(at),
                pa.array(proofs, pa.binary()),
            ], ["tree", "low", "proof"])

    return batches


def _verified(extra: list[str], height: int) -> Callable:
    """Rows of buckets to the leaves with the digest of their proof and the root folded from it."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for rows, members, nodes, steps, above in _bucket_rows(parts, 0, height):
            rest = _unpack(rows.column("proof")[above].as_py() or b"")
            tail = "".join(left + right for left, right in rest).encode()
            changed = rows.column("changed").combine_chunks().take(pa.array(members)).to_pylist()
            proofs, folded = [], []
            for runs, now in zip(steps, changed):
                seen = sha()
                for first, own, end, k in runs:
                    digests = nodes[k][2]
                    left, right = "".join(digests[first:own]), "".join(digests[own + 1:end])
                    seen.update((left + right).encode())
                    now = sha((left + now + right).encode()).hexdigest()
                seen.update(tail)
                for left, right in rest:
                    now = sha((left + now + right).encode()).hexdigest()
                proofs.append(seen.hexdigest())
                folded.append(now)
            at = pa.array(members)
            subroot = pa.array([rows.column("digest")[above].as_py()] * len(members), pa.string())
            yield pa.RecordBatch.from_arrays([
                *[rows.column(c).combine_chunks().take(at) for c in [*extra, "digest"]], subroot,
                pa.array(proofs, pa.string()), pa.array(folded, pa.string()),
            ], [*extra, "leaf", "subroot", "proof_sha256", "folded_root"])

    return batches


def _buckets(
    levels: list[DataFrame], members: DataFrame, first_level: int, height: int, above: DataFrame
) -> DataFrame:
    """Members, the nodes up to ``height`` levels above them and what lies above, by bucket and sorted."""
    width = FANOUT ** (first_level + height)
    bucket = F.floor(F.col("low") / width).cast("long")
    columns = ["tree", bucket.alias("bucket"), F.lit(first_level).cast("int").alias("level"), "low", "high", "digest"]
    extra = [c for c in members.columns if c not in ("tree", "size", "low", "high", "digest")]
    rows = members.select(*columns, *extra)
    for k in range(first_level + 1, min(first_level + height, len(levels) - 1) + 1):
        columns[2] = F.lit(k).cast("int").alias("level")
        rows = rows.unionByName(levels[k].select(*columns), allowMissingColumns=True)
    tops = above.select("tree", "bucket", F.lit(-1).cast("int").alias("level"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), "digest", "proof")
    return rows.unionByName(tops, allowMissingColumns=True).repartition(*BUCKET).sortWithinPartitions(*BUCKET, "level", "low")


def _above(levels: list[DataFrame], first_level: int, height: int, roots: DataFrame) -> DataFrame:
    """(tree, bucket, digest of the tree's root, proof) above each bucket of members at ``first_level``.

    ``roots``: tree, size, root and proof (what lies above the root, binary).
    """
    top = first_level + height
    width = FANOUT ** top
    least = FANOUT ** (first_level - 1) if first_level else 0
    ends = roots.where((F.col("size") <= width // FANOUT) & (F.col("size") > least)).select(
        "tree", F.lit(0).cast("long").alias("bucket"), F.col("root").alias("digest"), "proof"
    )
    if top >= len(levels):
        return ends
    members = levels[top]
    higher = _buckets(levels, members, top, height, _above(levels, top, height, roots))
    chains = stored(higher.mapInArrow(_chains(top, height), "tree string, low long, proof binary"), "merkle-proofs")
    # One row a tree: its root goes with every bucket. Proofs are one row a bucket of FANOUT ** height members.
    inner = chains.select("tree", F.floor(F.col("low") / width).cast("long").alias("bucket"), "proof").join(
        roots.select("tree", F.col("root").alias("digest")), "tree"
    )
    return ends.unionByName(inner.select("tree", "bucket", "digest", "proof"))


def merkle_manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", text: str = "text",
    tamper_every: int = TAMPER_EVERY, height: int = HEIGHT,
) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of ``fields``. The leaves of a ``group`` ascend by key (null first, equal keys by leaf) and are
    folded eight at a time into its subroot; subroots in order of their group (null first) are folded into the root.
    ``folded_root`` starts from the leaf of a tampered text where ``tamper_every`` divides the CRC-32 of the key; where
    nothing is changed by it, or the key is null, it starts from the leaf. Repeated rows are leaves of their own; null
    fields differ from empty ones; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    hit = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % tamper_every == 0, F.lit(False))
    touched = F.when(hit, F.translate(F.col(text), UPPER, LOWER)).otherwise(F.col(text))
    leaf = leaf_digest([F.col(c) for c in fields])
    changed = leaf_digest([touched if c == text else F.col(c) for c in fields])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(key).alias("key"),
        leaf.alias("digest"), F.when(hit, changed).otherwise(leaf).alias("changed"), F.monotonically_increasing_id().alias("row"),
    )
    ranked = stored(
        global_rank(stored(rows, "merkle-rows"), [F.col("key").asc_nulls_first(), F.col("digest"), F.col("row")], "place", ["tree"])
        .select("tree", "key", "digest", "changed", (F.col("place") - 1).alias("low")), "merkle-leaves",
    )
    sizes = ranked.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    levels = tree_levels(_with_size(ranked, sizes))
    roots = stored(tree_roots(levels), "merkle-roots")
    tops = stored(
        global_rank(roots.select("tree", F.col("root").alias("digest")), [F.col("tree")], "place")
        .select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), (F.col("place") - 1).alias("low"), "digest"), "merkle-tops",
    )
    top_levels = tree_levels(tops.withColumn("size", F.lit(tops.count()).cast("long")))
    crown = stored(tree_roots(top_levels), "merkle-crown").withColumn("proof", F.lit(b""))
    top_members = tops.select("tree", "low", (F.col("low") + 1).alias("high"), "digest")
    of_roots = _buckets(top_levels, top_members, 0, height, _above(top_levels, 0, height, crown)).mapInArrow(
        _chains(0, height), "tree string, low long, proof binary"
    )
    reached = stored(
        roots.join(tops.select("low", F.col("of").alias("tree")).join(of_roots.select("low", "proof"), "low").drop("low"), "tree"),
        "merkle-reached",
    )
    members = ranked.select("tree", "low", (F.col("low") + 1).alias("high"), "digest", "key", "changed")
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("key", kind), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")],
    ])
    checked = _buckets(levels, members, 0, height, _above(levels, 0, height, reached)).mapInArrow(_verified(["key"], height), schema)
    top = crown.first()
    root = F.lit(top["root"] if top else None).cast("string")
    return checked.select(
        F.col("key").alias(key), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def _with_size(leaves: DataFrame, sizes: DataFrame) -> DataFrame:
    """Leaves with the size of their tree; trees with many leaves are joined where their rows are."""
    counted = stored(sizes, "merkle-sizes")
    total = counted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return join_groups(leaves.select("tree", "low", "digest"), counted, ["tree"], "size", total)
