"""Exact duplicates by progressive refinement: length, then a prefix, then the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.spread import join_groups, seen_filter, with_seen
from riskloom.plans.materialise import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The compared form: A-Z in lower case, all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _full_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def _prefix(text: Column, chars: int) -> Column:
    return F.xxhash64(normalised(F.substring(text, 1, chars)))


def _short_name(length: Column, prefix: Column) -> Column:
    return F.xxhash64(length, prefix)


def _with_candidates(
    rows: DataFrame, text: Column, prefix_chars: int, lengths: DataFrame, prefixes: DataFrame | None = None
) -> DataFrame:
    """Add __length and __alike: whether the row may share its length (and prefix) with another."""
    rows = rows.withColumn("__length", _length(text).cast("long"))
    rows = with_seen(rows, F.xxhash64("__length"), "__alike", lengths)
    if prefixes is None:
        return rows
    name = F.when(F.col("__alike"), _short_name(F.col("__length"), _prefix(text, prefix_chars)))
    seen = with_seen(rows, F.coalesce(name, F.lit(0)), "__near", prefixes)
    return seen.withColumn("__alike", F.col("__alike") & F.col("__near")).drop("__near")


def repeated_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS
) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """Groups of equal texts found by refinement, and the filters of lengths and prefixes that led to them.

    1. lengths in bytes that more than one row has (counts merge before the shuffle);
    2. among those, prefix hashes that more than one row has;
    3. among those, digests of the whole text that more than one row has.
    Each step reads more of the text of fewer rows, and no text is moved: what a step found reaches the rows as
    a filter of fixed size, whose rare false hits only cost a hash. Returns (length, digest, keep_id, group_size).
    """
    t = F.col(text)
    several = F.col("n") > 1
    rows = docs.select(F.col(key).alias("key"), t.alias("__text"))
    t = F.col("__text")
    lengths = stored(
        rows.groupBy(_length(t).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n")).where(several), "dedup-lengths"
    )
    by_length = stored(seen_filter(lengths, F.xxhash64("length")), "dedup-length-filter")
    prefixes = (
        _with_candidates(rows, t, prefix_chars, by_length).where("__alike")
        .groupBy(_short_name(F.col("__length"), _prefix(t, prefix_chars)).alias("name")).agg(F.count(F.lit(1)).alias("n")).where(several)
    )
    by_prefix = stored(seen_filter(prefixes, F.col("name")), "dedup-prefix-filter")
    groups = stored(
        _with_candidates(rows, t, prefix_chars, by_length, by_prefix).where("__alike")
        .groupBy(F.col("__length").alias("length"), _full_digest(t).alias("digest"))
        .agg(F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "dedup-groups",
    )
    return groups, (by_length, by_prefix)


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """One row per row of ``docs``: key, digest, keep_id, group_size, kept.

    Texts are equal when ``normalised`` makes them identical. Of a group the row with
    the largest key stays; of repeated rows with that key exactly one stays. Null texts
    are one group with empty ones; a null key stays only if its whole group has null
    keys. An empty table gives no rows; other columns are not read. Groups come from the refinement; the
    digest of rows outside them is made for this table only.
    """
    groups, _ = repeated_groups(docs, key, text, prefix_chars)
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    rows = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("__text"))
        .select("key", _length(F.col("__text")).cast("long").alias("length"), _full_digest(F.col("__text")).alias("digest"))
        # Repeated rows become one row with a count before anything is joined.
        .groupBy("key", "length", "digest").agg(F.count(F.lit(1)).alias("times"))
    )
    single = F.col("group_size").isNull()
    return (
        join_groups(rows, groups, ["length", "digest"], "group_size", total)
        .select(
            "key", "digest", F.when(single, F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("turn"),
        )
        .select(
            F.col("key").alias(key), "digest", "keep_id", "group_size",
            (F.col("key").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
        )
    )


def drop_exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows whose length and prefix no other row has stay where they are. Of the others only the names (key and
    digest) meet their groups; rows that a filter of the dropped names does not hold stay where they are too, and the
    rest, little more than what is dropped, is moved to be told apart exactly. Of repeated rows one stays.
    """
    groups, (by_length, by_prefix) = repeated_groups(docs, key, text, prefix_chars)
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    name = F.xxhash64(key, "__digest")
    rows = _with_candidates(docs, F.col(text), prefix_chars, by_length, by_prefix)
    alike = rows.where("__alike").select(F.col(key).alias("key"), F.col("__length").alias("length"), _full_digest(F.col(text)).alias("digest"))
    met = join_groups(
        alike.groupBy("key", "length", "digest").agg(F.count(F.lit(1)).alias("times")), groups, ["length", "digest"], "group_size", total
    ).where("group_size is not null")
    marked = stored(
        met.select(F.col("key").alias("__k"), F.col("digest").alias("__d"), F.col("key").eqNullSafe(F.col("keep_id")).alias("__kept"), "times")
        .where("not __kept or times > 1"), "dedup-dropped",
    )
    gone = stored(seen_filter(marked, F.xxhash64("__k", "__d")), "dedup-dropped-filter")
    hashed = rows.withColumn("__digest", F.when(F.col("__alike"), _full_digest(F.col(text))))
    told = with_seen(hashed, F.when(F.col("__alike"), name).otherwise(F.lit(0)), "__hit", gone)
    in_doubt = F.col("__alike") & F.col("__hit")
    some = stored(told.where(in_doubt).select(*docs.columns, "__digest"), "dedup-doubtful")
    same = some[key].eqNullSafe(F.col("__k")) & (some["__digest"] == F.col("__d"))
    free = some.join(marked, same, "left_anti")
    cut = some.join(marked.where("__kept"), same, "left_semi").dropDuplicates([key, "__digest"])
    return told.where(~in_doubt).select(*docs.columns).unionByName(free.unionByName(cut).select(*docs.columns))
