"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is shuffled into a stream of words and cut into blocks of equal words. A
rank-one golden-ratio lattice visits the slots of the mix: its points are mapped through the
cumulative weights of the sources, slots are ranked per source, and the rank of a slot
names the block, of the first or of a repeated pass over the source, that fills it.
DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.spread import AT_RANGE, digest_at, join_groups, running_sums
from riskloom.operators.ordering import global_rank, running_totals
from riskloom.plans.materialise import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 1024
# Slots per cell in which points and sources meet.
CELL = 4096
_SPLIT = 1 << 20
SEED = "mix"
# Order of rows with the same place in the stream.
ORDER = ("key", "size", "mark", "turn")


@dataclass(frozen=True)
class Mix:
    """Tables of a mix, all in the shared folder.

    ``documents``: key, source, size, mark (digest of the text), turn (of equal rows), position of the source, start in
    its stream.
    ``sources``: position, source, source_size, target, words (target in whole words).
    ``slots``: slot, position, epoch, block, words.
    ``pieces``: slot, position, epoch, start and key of the document, skip (words left out
    before the piece), words.
    """

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def _mark(text: Column) -> Column:
    """What tells documents of equal key and size apart."""
    return F.md5(F.coalesce(text, F.lit("")))


def _place_in(key: Column, mark: Column, turn: Column) -> Column:
    """Place of a row in the shuffled stream of its source."""
    said = F.coalesce(key.cast("string"), F.lit(""))
    return digest_at(F.concat(F.lit(SEED), said, F.lit(":"), mark, F.lit(":"), turn.cast("string")))


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Targets of the sources (source, source_size): position, weight, target, words.

    Sources in code-point order, null last, take the weights in turn. No target exceeds
    ``most`` times its source; the excess is shared by weight among the rest. Sources
    sorted by the level at which they fill up are filled in that order, so one running
    total finds all full ones.
    """
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    placed = (
        global_rank(sizes, [F.col("source").asc_nulls_last()], "position")
        .withColumn("position", F.col("position") - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
    )
    level = F.col("cap") / F.col("weight")
    filling = stored(
        running_totals(placed, [level, F.col("position")], {"caps": "cap", "upto": "weight"}), "mix-filling"
    )
    total, whole = filling.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
    ).first()
    free_words = F.lit(total) - (F.col("caps") - F.col("cap"))
    free_weight = F.lit(whole) - (F.col("upto") - F.col("weight"))
    full = F.col("cap") * free_weight <= F.col("weight") * free_words
    caps, weight = filling.where(full).agg(
        F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
    ).first()
    share = F.col("weight") * F.lit(total - caps) / F.lit(max(1, whole - weight))
    target = F.when(full, F.col("cap").cast("double")).otherwise(share.cast("double"))
    return filling.select(
        "position", "source", "source_size", "weight", target.alias("target"), F.floor(target).alias("words")
    )


def lattice_step(n: int) -> int:
    """The step nearest to ``n`` over the golden ratio that visits all of 0..n-1."""
    near = max(1, round(n * 0.6180339887498949))
    return next(
        g for away in range(n + 2) for g in (near - away, near + away) if g > 0 and gcd(g, n) == 1
    )


def lattice_point(slot: Column, step: int, n: int) -> Column:
    """slot * step mod n, without a product beyond 64 bits for up to 2^41 slots."""
    high, low = F.floor(slot / _SPLIT).cast("long"), slot % _SPLIT
    return (high * F.lit(_SPLIT * step % n) % n + low * F.lit(step) % n) % n


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS,
) -> Mix:
    """Mix all rows of ``docs`` to the weights of their sources.

    A source is visited in whole passes, the last one cut where its words are reached, so
    no document is taken more than ``most`` times. The shuffle is a hash of the key: reruns
    agree. Null texts have no words; a null source is a source; repeated rows are rows of
    their own, told apart by a turn number. No rows give an empty mix.
    """
    spark = docs.sparkSession
    rows = stored(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _mark(F.col(text)).alias("mark"))
        # Equal rows are merged before they are spread again by their turns: none of them owns a task.
        .groupBy("key", "source", "size", "mark").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n"), "mix-sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = source_targets(sizes.select("source", "source_size"), weights, most)
    b = F.lit(block_words)
    ceil_div = lambda a: F.floor((a + b - 1) / b).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long")
    plan = stored(
        running_totals(
            targets.withColumn("full", passes)
            .withColumn("rest", F.col("words") - F.col("full") * F.col("source_size"))
            .withColumn("blocks", ceil_div(F.col("source_size")))
            .withColumn("n_slots", F.col("full") * F.col("blocks") + ceil_div(F.col("rest"))),
            [F.col("position")], {"slots_upto": "n_slots"},
        ), "mix-sources",
    )
    n_slots = plan.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    n_rows = rows.count()

    placed = rows.join(
        plan.select("position", F.col("source").alias("__s"), "blocks"), F.col("source").eqNullSafe(F.col("__s"))
    ).drop("__s")
    documents = stored(
        running_sums(placed, ["position"], _place_in(*[F.col(c) for c in ("key", "mark", "turn")]), [F.col(c) for c in ORDER], {"start": F.col("size")}, n_rows), "mix-documents"
    )

    step = lattice_step(max(1, n_slots))
    cells = plan.where("n_slots > 0").withColumn("first", F.col("slots_upto") - F.col("n_slots")).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor((F.col("slots_upto") - 1) / CELL)))
    )
    points = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn(
        "point", lattice_point(F.col("slot"), step, max(1, n_slots))
    ).withColumn("cell", F.floor(F.col("point") / CELL))
    drawn = points.join(cells, "cell").where("point >= first and point < slots_upto")
    slot_at = F.floor(F.col("slot") * F.lit(float(AT_RANGE) / max(1, n_slots))).cast("long")
    ranked = running_sums(drawn, ["position"], slot_at, [F.col("slot")], {"rank": F.lit(1).cast("long")}, n_slots)
    block = F.col("rank") % F.col("blocks")
    epoch = F.floor(F.col("rank") / F.col("blocks"))
    in_block = F.least(b, F.when(epoch < F.col("full"), F.col("source_size")).otherwise(F.col("rest")) - block * b)
    slots = stored(
        ranked.select("slot", "position", epoch.alias("epoch"), block.alias("block"), in_block.cast("long").alias("words")),
        "mix-slots",
    )

    spans = documents.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)))
    )
    begin = F.greatest(F.col("start"), F.col("block") * b)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("words"))
    pieces = (
        spans.drop("source", "blocks", "mark", "turn").join(slots, ["position", "block"])
        .select("slot", "position", "epoch", "start", "key", "size",
                (begin - F.col("start")).alias("skip"), (end - begin).alias("words"))
        .where("words > 0")
    )
    return Mix(documents, plan.select("position", "source", "source_size", "target", "words"), slots, pieces)


def words_taken(mix: Mix) -> DataFrame:
    """Every document with its source's size and target and the words the mix takes of it."""
    taken = mix.pieces.groupBy("position", "start", "key", "size").agg(F.sum("words").alias("taken"))
    filled = mix.documents.where("size > 0").select("position", "start", "key", "size")
    with_words = (
        filled.withColumn("taken", F.lit(0).cast("long")).unionByName(taken)
        .groupBy("position", "start", "key", "size").agg(F.max("taken").alias("taken"))
        .select("position", "start", "key", "size", "taken")
    )
    without = mix.documents.where("size = 0").select("position", "start", "key", "size", F.lit(0).cast("long").alias("taken"))
    return with_words.unionByName(without).join(
        mix.sources.select("position", "source", "source_size", "target"), "position"
    )


def copies_by_place(mix: Mix) -> DataFrame:
    """(source, n_rows, most, fewer_from): how often each source's documents are given.

    A document is given once per pass in which at least half of its words are taken. Passes are
    whole but for the last, so the numbers of a source fall once along its stream: from ``most`` by one, at the
    document that stands at ``fewer_from`` (place and order; null where no number is smaller).
    """
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    given = words_taken(mix).where("size > 0").select("position", "start", copies.alias("copies"))
    at = mix.documents.where("size > 0").select("position", "start", F.struct(_place_in(*[F.col(c) for c in ("key", "mark", "turn")]).alias("place"), *ORDER).alias("at"))
    counted = given.join(at, ["position", "start"])
    sums = counted.groupBy("position").agg(
        F.max("copies").alias("most"), F.min(F.struct("copies", "at")).alias("least"),
    )
    rows = mix.documents.groupBy("position").agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        rows.join(sums, "position", "left").join(mix.sources.select("position", "source"), "position")
        .select(
            "source", "n_rows", F.coalesce("most", F.lit(0)).alias("most"),
            F.when(F.col("least.copies") < F.col("most"), F.col("least.at")).alias("fewer_from"),
        )
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    A document is given once per pass in which at least half of its words are taken; one
    without words costs nothing and is kept once. Rows that are equal in key, source and text are given as often as the
    first of them. Documents stay where they are: each finds its own number from its place in the stream and
    the one place of its source at which the numbers fall.
    """
    plan = stored(copies_by_place(mix_sources(docs, key, text, source)), "mix-copies")
    total = plan.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    falls = plan.select(named.alias("__source"), F.col("n_rows").alias("__n"), F.col("most").alias("__most"), F.col("fewer_from").alias("__from"))
    rows = docs.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    met = join_groups(rows, falls, ["__source"], "__n", total)
    size = word_count(F.col(text))
    order = met.select(
        "*", size.alias("__size"), F.struct(
            _place_in(F.col(key), _mark(F.col(text)), F.lit(1)).alias("place"), F.col(key).alias("key"), size.alias("size"), _mark(F.col(text)).alias("mark"),
            F.lit(1).cast("long").alias("turn"),
        ).alias("__here"),
    )
    fewer = F.coalesce(F.col("__here") >= F.col("__from"), F.lit(False))
    copies = F.when(F.col("__size") == 0, 1).otherwise(F.col("__most") - fewer.cast("int"))
    return order.withColumn("__copies", copies).where("__copies > 0").withColumn(
        "__turn", F.explode(F.sequence(F.lit(1), F.col("__copies")))
    ).select(*docs.columns)
