"""Incident intervals, day labels, class weights and user splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import global_rank


def of_version(incidents: DataFrame, version: str) -> DataFrame:
    """Incidents of one corpus version; the column is compared as text."""
    return incidents.where(F.col("dataset").cast("string") == version)


def distinct_insiders(incidents: DataFrame, version: str) -> DataFrame:
    """The distinct users of one version."""
    return of_version(incidents, version).select("user").distinct()


def scenario_counts(incidents: DataFrame, version: str) -> DataFrame:
    """Incidents per scenario."""
    return (
        of_version(incidents, version).groupBy("scenario")
        .agg(F.count(F.lit(1)).alias("incidents")).orderBy("scenario")
    )


def incident_days(incidents: DataFrame, version: str, shift_days: int = 0) -> DataFrame:
    """Distinct (user, day) inside an interval, both ends included.

    Intervals without an end or with an end before the start give no day.
    ``shift_days`` moves the days to match shifted features; 0 keeps them as given.
    """
    start, end = F.to_date("start"), F.to_date("end")
    return (
        of_version(incidents, version)
        .where(start.isNotNull() & end.isNotNull() & (start <= end))
        .select("user", F.explode(F.sequence(start, end)).alias("day"))
        .select("user", F.date_add("day", shift_days).alias("day"))
        .distinct()
    )


def with_labels(
    table: DataFrame, incidents: DataFrame, version: str, shift_days: int = 0
) -> DataFrame:
    """Add ``insider_label``. Spark broadcasts the label days when they are small."""
    days = incident_days(incidents, version, shift_days).withColumn("__hit", F.lit(1))
    return (
        table.join(days, ["user", "day"], "left")
        .withColumn("insider_label", F.coalesce("__hit", F.lit(0))).drop("__hit")
    )


def label_balance(table: DataFrame) -> DataFrame:
    """Rows per class and the number of normal days per insider day."""
    positive = F.count_if(F.col("insider_label") == 1)
    negative = F.count_if(F.col("insider_label") == 0)
    return table.agg(
        positive.alias("insider_days"), negative.alias("normal_days"),
        F.floor(negative / F.greatest(positive, F.lit(1))).alias("normal_per_insider"),
    )


def with_class_weights(
    table: DataFrame, power: int = 1, label: str = "insider_label", name: str = "weight"
) -> DataFrame:
    """Balanced class weight n / (2 * n of the class), raised to ``power``.

    The two counts come from one aggregate; a window per class would put half the
    table in one task.
    """
    totals = table.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positive")
        ).alias("t")
    ).scalar()
    own = F.when(F.col(label) == 1, totals["positive"]).otherwise(totals["n"] - totals["positive"])
    return table.withColumn(name, F.pow(totals["n"] / (2 * own), F.lit(float(power))))


def insider_users(table: DataFrame) -> DataFrame:
    """One row per user: 1 when any of the user's days is labelled."""
    return table.groupBy("user").agg(F.max("insider_label").alias("is_insider"))


def seeded_hash(column: str, seed: int) -> Column:
    """Deterministic shuffle key: the same text and seed give the same order anywhere."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")))


def holdout_users(users: DataFrame, seed: int, share: float = 0.2) -> DataFrame:
    """Add ``is_test``: a share of the insiders (at least one) and of the other users.

    Users are taken in the order of a seeded hash within their class.
    """
    ranked = global_rank(
        users.withColumn("__hash", seeded_hash("user", seed)),
        [F.col("__hash"), F.col("user")], "__rank", groups=["is_insider"],
    )
    sizes = users.groupBy("is_insider").agg(F.count(F.lit(1)).alias("__n"))  # two rows
    wanted = F.floor(F.col("__n") * share)
    wanted = F.when(F.col("is_insider") == 1, F.greatest(wanted, F.lit(1))).otherwise(wanted)
    return (
        ranked.join(F.broadcast(sizes), "is_insider")
        .withColumn("is_test", (F.col("__rank") <= wanted).cast("int"))
        .drop("__hash", "__rank", "__n")
    )


def stratified_folds(table: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """Add ``fold``: classes are dealt out evenly in the order of a seeded hash."""
    ranked = global_rank(
        table.withColumn("__hash", seeded_hash(key, seed)),
        [F.col("__hash"), F.col(key)], "__rank", groups=["insider_label"],
    )
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % folds).cast("int")).drop("__hash", "__rank")


def of_users(table: DataFrame, users: DataFrame) -> DataFrame:
    """Rows whose user is in the set."""
    return table.join(users.select("user"), "user", "left_semi")
