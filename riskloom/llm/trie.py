"""The trie of conversation prefixes, totalled by depth bands.

A node is a distinct sequence of first turns. Its name is the exclusive or of a hash per (position,
turn), so prefixes are running sums that no task has to follow from the start of a long
conversation. Totals of subtrees come in two moves. Upwards, every node adds to its ancestors
inside its band of ``BAND`` depths; the tops of the bands form a smaller trie that is treated in
the same way. Downwards, the completed total of a band's top is added to the ancestors of its
parent inside the parent's band. Rounds grow with the logarithm of the depth, and a
node is copied at most ``BAND`` times in each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.mixing import word_count
from riskloom.llm.spread import join_groups
from riskloom.operators.ordering import global_rank
from riskloom.plans.materialise import stored

# Depths of a band, and positions of one conversation that a task follows: a power of BAND.
BAND = 8
RUN = BAND ** 4
# Conversations whose numbers are joined into one piece of a list.
LIST_ROWS = 4096
GROUP = 20
BORROWED = 4
ID = ["depth", "a", "b"]


def _of_group(conv: Column) -> Column:
    """The conversation whose first turns a conversation starts with."""
    return conv - conv % GROUP


def _borrowed(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % BORROWED).cast("long")


def ordered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, i, digest, words): turns of each conversation from 1 in order.

    Null turns come first; equal turns are ordered by their digest. Whole texts are read here only;
    later steps move the digest of a turn. Rows without a conversation are left out.
    """
    said = F.coalesce(F.col(role).cast("string"), F.lit(""))
    words = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, words))
    turns = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"),
        word_count(words).alias("words"),
    )
    # Equal rows are told apart by a number, so that the order names every row.
    ranked = stored(global_rank(
        turns.withColumn("row", F.monotonically_increasing_id()),
        [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")], "place",
    ).select("conv_id", "place", "digest", "words"), "trie-turns")
    sizes = ranked.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    return join_groups(ranked, sizes, ["conv_id"], "n", ranked.count()).select(
        "conv_id", (F.col("place") - F.col("first") + 1).alias("i"), "digest", "words"
    )


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, words, last): the rebuilt conversations, each from its root at depth 0."""
    convs = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-conversations")
    heads = convs.select(F.col("conv_id").alias("from"), F.col("n").alias("n_from"))
    plan = stored(
        convs.withColumns({"from": _of_group(F.col("conv_id")), "h": _borrowed(F.col("conv_id"))})
        .join(heads, "from", "left")
        .withColumn("taken", F.least("h", F.coalesce("n_from", F.lit(0).cast("long"))))
        .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long")))
        .select("conv_id", "from", "n", "h", "taken", "length"), "trie-plan",
    )
    total = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = (
        join_groups(turns, plan.select("conv_id", "n", "h", "taken", "length"), ["conv_id"], "n", total)
        .where("i > h")
        .select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("depth"), "digest", "words", "length")
    )
    # At most BORROWED - 1 rows a conversation; a head serves at most 2 * GROUP - 1 conversations.
    wanted = plan.where("taken > 0").select("conv_id", "from", "length", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("i"))
    first = turns.where(F.col("i") < BORROWED).select(F.col("conv_id").alias("from"), "i", "digest", "words")
    lent = wanted.join(first, ["from", "i"]).select("conv_id", F.col("i").alias("depth"), "digest", "words", "length")
    roots = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"), "length")
    return own.unionByName(lent).unionByName(roots).select(
        "conv_id", "depth", "digest", "words", (F.col("depth") == F.col("length")).alias("last")
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """Add (a, b), the name of the prefix that ends at each row; the root is (0, 0).

    Conversations are cut every ``RUN`` positions; a part starts from the sum of the parts before it.
    """
    salted = turns.withColumns({
        "run": F.floor(F.col("depth") / RUN).cast("long"),
        "a": F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("depth", "digest")),
        "b": F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("digest", "depth", F.lit("b"))),
    })
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("conv_id", "run").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
        .select("conv_id", "run", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0).cast("long")).alias(f"{c}0") for c in "ab"])
        .where("run > 0")
    )
    inside = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    return (
        salted.withColumns({c: F.bit_xor(c).over(inside) for c in "ab"})
        .join(starts, ["conv_id", "run"], "left")
        .withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"{c}0", zero)) for c in "ab"})
        .select("conv_id", "depth", "a", "b", "words", "last")
    )


def _level_nodes(rows: DataFrame, level: int) -> DataFrame:
    """Nodes whose depth is a multiple of BAND**level, with their ancestors among those nodes.

    ``path`` holds the names of the ancestors inside the band, the top of the band first and the node
    last; ``parent`` is the nearest ancestor. Every member of a node has the same path, so any serves.
    """
    step = BAND ** level
    place = F.floor(F.col("depth") / step).cast("long")
    name = F.struct(*ID)
    placed = rows.where(F.col("depth") % step == 0).withColumns({"place": place, "run": F.floor(place / RUN).cast("long")})
    # The last row of a part is copied into the next one, for the parent of that part's first row.
    both = placed.withColumn("part", F.explode(
        F.when(F.col("place") % RUN == RUN - 1, F.array(F.col("run"), F.col("run") + 1)).otherwise(F.array(F.col("run")))
    ))
    window = Window.partitionBy("conv_id", "part").orderBy("place")
    seen = (
        both.withColumns({
            "parent": F.lag(name).over(window),
            "path": F.slice(
                F.collect_list(name).over(window.rowsBetween(1 - BAND, 0)), -(F.col("place") % BAND + 1).cast("int"),
                (F.col("place") % BAND + 1).cast("int"),
            ),
        }).where("part = run")
    )
    return seen.groupBy(*ID).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.first("parent").alias("parent"), F.first("path").alias("path"),
    )


def _added(paths: DataFrame, values: list[str]) -> DataFrame:
    """Add the values of each row to every name in its ``path``."""
    return (
        paths.select(F.explode("path").alias("to"), *values).select("to.*", *values)
        .groupBy(*ID).agg(*[F.sum(v).alias(v) for v in values])
    )


def subtree_totals(rows: DataFrame, nodes: DataFrame, values: list[str], deepest: int, level: int = 0) -> DataFrame:
    """(depth, a, b, values): each node's values added over its subtree.

    ``nodes`` are those of a level with ``parent``, ``path`` and values; ``rows`` the prefixes they come from.
    """
    inside = stored(_added(nodes, values), "trie-bands")
    step = BAND ** level
    if deepest // step < BAND:
        return inside
    tops = stored(
        _level_nodes(rows, level + 1).drop("conv_id", "n_convs", "words")
        .join(inside, ID), "trie-tops",
    )
    whole = subtree_totals(rows, tops, values, deepest, level + 1)
    # Completed totals of the tops, merged per parent before they meet its path: no hot parent.
    above = nodes.where((F.col("depth") % (step * BAND) == 0) & (F.col("depth") > 0)).select(*ID, "parent")
    sent = (
        whole.join(above, ID).groupBy("parent").agg(*[F.sum(v).alias(v) for v in values])
        .select("parent.*", *values).join(nodes.select(*ID, "path"), ID)
    )
    return inside.unionByName(_added(sent, values)).groupBy(*ID).agg(*[F.sum(v).alias(v) for v in values])


def _list_digests() -> object:
    """Rows (depth, a, b, piece, text), sorted, to the digest of each node's joined pieces."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for part in parts:
            columns = [part.column(k).to_pylist() for k in (0, 1, 2, 4)]
            for *name, text in zip(*columns):
                if name != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = name, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield _digest_batch(done)
                done = []
        if now is not None:
            yield _digest_batch([(*now, state.hexdigest())])

    return batches


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    depth, a, b, digest = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(x, np.int64)) for x in (depth, a, b)] + [pa.array(digest)], [*ID, "ends"]
    )


def ends_digests(rows: DataFrame) -> DataFrame:
    """(depth, a, b, ends): SHA-256 of the ascending numbers of the conversations that end at a node.

    Numbers are joined in pieces of at most ``LIST_ROWS`` neighbours first; the digest of a
    node reads its pieces in order, one at a time.
    """
    ends = stored(global_rank(rows.where("last").select("conv_id", *ID), [F.col("conv_id")], "place"), "trie-ends")
    pieces = ends.groupBy(*ID, F.floor(F.col("place") / LIST_ROWS).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text")
    )
    return (
        pieces.repartition(*ID).sortWithinPartitions(*ID, "piece")
        .mapInArrow(_list_digests(), "depth long, a long, b long, ends string")
    )


def conversation_trie(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and a, b, the node's name.

    Null roles and texts are empty; null turns come first; equal turns are ordered by a digest of role and
    text, so repeated rows stay turns of their own. Rows whose conversation is null are left out. No
    conversation gives no node, not even a root. Other columns are not read.
    """
    seen = stored(prefixes(rebuilt_turns(ordered_turns(rows, conv, turn, role, text))), "trie-prefixes")
    nodes = stored(_level_nodes(seen, 0), "trie-nodes")
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    children = stored(
        nodes.where("depth > 0").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).select("parent.*", "n_children"),
        "trie-children",
    )
    zero = F.lit(0).cast("long")
    own = stored(
        nodes.join(children, ID, "left").join(ends_digests(seen), ID, "left")
        .withColumns({
            "n_children": F.coalesce("n_children", zero),
            "n_leaves": F.when(F.col("n_children").isNull(), F.lit(1).cast("long")).otherwise(zero),
            "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
        }), "trie-own",
    )
    totals = subtree_totals(seen, own, ["n_leaves", "saved_tokens"], deepest)
    named = own.select(*[F.col(c).alias(f"p_{c}") for c in ID], F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = named.where("n_children > 0")
    whole = own.select(
        *ID, "conv_id", "n_convs", "n_children", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        F.col("parent.depth").alias("p_depth"), F.col("parent.a").alias("p_a"), F.col("parent.b").alias("p_b"),
    ).join(totals, ID)
    below = whole.where("depth > 0")
    met = join_groups(
        below, parents.select("p_depth", "p_a", "p_b", "parent_conv_id", F.col("n_children").alias("n_siblings")),
        ["p_depth", "p_a", "p_b"], "n_siblings", max(1, own.count()),
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "a", "b"]
    top = whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return met.select(*columns).unionByName(top.select(*columns))
