"""The user-day table: fills, compound signal, feature selection, output schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import HOST_DAY_COLUMNS, NON_FEATURES


def outer_assemble(logon: DataFrame, device: DataFrame, web: DataFrame) -> DataFrame:
    """Full outer join of three user-day tables; the stacked form in ``daily`` shuffles less."""
    keys = ["user", "day"]
    return logon.join(device, keys, "full").join(web, keys, "full")


def is_zscore(name: str) -> bool:
    """True for z-score columns and their baseline flags, which keep their nulls."""
    return "zscore" in name or "z_score" in name


def fill_numeric(table: DataFrame, keep_null: Iterable[str] = ()) -> DataFrame:
    """Nulls of numeric columns become 0, except in z-score columns and ``keep_null``."""
    kept = set(keep_null)
    filled = [
        f.name for f in table.schema.fields
        if isinstance(f.dataType, T.NumericType) and not is_zscore(f.name) and f.name not in kept
    ]
    return table.fillna(0, subset=filled)


def without_empty_days(table: DataFrame) -> DataFrame:
    """Keep a day with after-hours rows, a logon z-score, a device or a job-site visit.

    A logon day without any of these is dropped as well.
    """
    signs = [
        F.col("after_hours_session_count") > 0, F.col("logon_count_zscore").isNotNull(),
        F.col("usb_count") > 0, F.col("job_site_visits_flag") > 0,
    ]
    kept = F.lit(False)
    for sign in signs:
        kept = kept | F.coalesce(sign, F.lit(False))
    return table.where(kept)


def with_weekly_compound(
    table: DataFrame, usb: str, job: str = "job_site_visits_flag",
    name: str = "job_search_plus_usb_week", days: int = 7,
) -> DataFrame:
    """1 when both signals were positive within the user's last ``days`` calendar days.

    ``usb`` is the z-score in the corpus flow and the count in the host flow.
    """
    week = (
        Window.partitionBy("user").orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    )
    both = (F.max(job).over(week) > 0) & (F.max(usb).over(week) > 0)
    return table.withColumn(name, F.coalesce(both, F.lit(False)).cast("int"))


def feature_columns(table: DataFrame, ignore: Sequence[str] = NON_FEATURES) -> list[str]:
    """Columns left once identifiers and labels are taken out."""
    return [c for c in table.columns if c not in set(ignore)]


def imputed(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles without nulls; identifiers stay as they are."""
    return table.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def unexpected_nulls(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features outside the z-scores that hold nulls, with the number of rows."""
    plain = [f for f in features if not is_zscore(f)]
    counted = table.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in plain])
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("nulls")) for f in plain
    ])
    return counted.select(F.inline(entries)).where(F.col("nulls") > 0)


def align(table: DataFrame, trained: Sequence[str], keys: Sequence[str] = ("user", "day")) -> DataFrame:
    """The columns a model was trained on, in its order; what is missing is 0."""
    def feature(name: str) -> Column:
        if name not in table.columns:
            return F.lit(0.0).alias(name)
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name)

    return table.select(*keys, *[feature(f) for f in trained])


def host_day_schema(table: DataFrame) -> DataFrame:
    """The fixed host columns in order; ``day`` is text and what is missing is null."""
    table = table.withColumns({"date": F.col("day"), "day": F.date_format("day", "MM/dd/yyyy")})
    return table.select(*[
        F.col(c) if c in table.columns else F.lit(None).cast("double").alias(c)
        for c in HOST_DAY_COLUMNS
    ])
