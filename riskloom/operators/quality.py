"""Data-quality checks as rows (check, column, metric, value, status)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.labels import seeded_hash
from riskloom.operators.ordering import all_of, exact_quantiles, heavy_values, value_counts
from riskloom.plans.materialise import stored

COLUMNS = ["check", "column", "metric", "value", "status"]


def _row(check: str, column: str, metric: str, value: Column, status: Column | str = "INFO") -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    return F.struct(
        F.lit(check).alias("check"), F.lit(column).alias("column"), F.lit(metric).alias("metric"),
        value.cast("double").alias("value"), status.alias("status"),
    )


def _rows(one: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """Turn a one-row aggregate into report rows."""
    return one.select(F.inline(F.array(*rows)))


def _status(bad: Column, label: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), label).otherwise("PASS")


def _share(condition: Column) -> Column:
    """Percent of all rows; a null condition counts as not met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double")) * 100


def check_shape(table: DataFrame, minimum_rows: int = 3) -> DataFrame:
    """Rows, columns, users, and rows per user; warns about users with few rows."""
    per_user = table.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    middle = exact_quantiles(per_user, {"n": "n"}, {"median": ("n", 0.5)}).scalar()
    one = per_user.agg(
        F.sum("n").alias("rows"), F.count("user").alias("users"),
        F.min("n").alias("least"), F.max("n").alias("most"),
    ).withColumn("median", middle)
    return _rows(one, [
        _row("shape", "", "rows", F.col("rows")),
        _row("shape", "", "columns", F.lit(len(table.columns))),
        _row("shape", "user", "users", F.col("users")),
        _row("shape", "user", "rows_per_user_min", F.col("least"),
             _status(F.col("least") < minimum_rows, "WARN")),
        _row("shape", "user", "rows_per_user_median", F.col("median")),
        _row("shape", "user", "rows_per_user_max", F.col("most")),
    ])


# Aggregates of one row, and the report rows made of them. They serve a pass of their own or the write of the table.
Parts = tuple[list[Column], list[Column]]


def _columns_parts(table: DataFrame, required: Sequence[str]) -> Parts:
    held = [c for c in required if c in table.columns]
    return [F.count(c).alias(f"filled_{c}") for c in held] or [F.count(F.lit(1)).alias("filled")], [
        _row("columns", c, "filled_rows", F.col(f"filled_{c}"), "PASS") if c in held
        else _row("columns", c, "filled_rows", F.lit(0), "FAIL")
        for c in required
    ]


def check_columns(table: DataFrame, required: Sequence[str]) -> DataFrame:
    """Filled rows of each required column; FAIL for a column the table lacks."""
    aggregates, rows = _columns_parts(table, required)
    return _rows(table.agg(*aggregates), rows)


def _dates_parts(day: Column, off_days: Sequence[int], limit_percent: float) -> Parts:
    return [
        F.count_if(day.isNull()).alias("bad_days"), _share(F.weekday(day).isin(*off_days)).alias("off_days"),
        *[F.count_if(F.weekday(day) == w).alias(f"weekday_{w}") for w in range(7)],
    ], [
        _row("dates", "day", "unparseable", F.col("bad_days"), _status(F.col("bad_days") > 0, "FAIL")),
        *[_row("dates", "day", f"weekday_{w}", F.col(f"weekday_{w}")) for w in range(7)],
        _row("dates", "day", "off_day_percent", F.col("off_days"), _status(F.col("off_days") > limit_percent, "INFO")),
    ]


def check_dates(
    table: DataFrame, day: Column, off_days: Sequence[int] = (5, 6), limit_percent: float = 0.05
) -> DataFrame:
    """Unparseable days, rows per weekday (0 is Monday) and the share on the given days."""
    aggregates, rows = _dates_parts(F.col("d"), off_days, limit_percent)
    return _rows(table.select(day.alias("d")).agg(*aggregates), rows)


def check_zscores(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation, 99th percentile and share of zeros; warns about odd shapes."""
    tails = exact_quantiles(table, {c: c for c in columns}, {c: (c, 0.99) for c in columns})
    tail = tails.select(F.struct("*").alias("t")).scalar()
    one = table.agg(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 _share(F.col(c) == 0).alias("zeros")).alias(c)
        for c in columns
    ]).withColumn("__t", tail)
    rows = []
    for c in columns:
        s = F.col(c)
        rows += [
            _row("zscore", c, "mean", s["mean"], _status(F.abs(s["mean"]) > 0.5, "WARN")),
            _row("zscore", c, "std", s["std"], _status((s["std"] < 0.5) | (s["std"] > 2.0), "WARN")),
            _row("zscore", c, "p99", F.col("__t")[c]),
            _row("zscore", c, "zero_percent", s["zeros"], _status(s["zeros"] > 60, "WARN")),
        ]
    return _rows(one, rows)


def _flags_parts(columns: Sequence[str]) -> Parts:
    aggregates, rows = [], []
    for c in columns:
        bad, rate = F.col(f"bad_{c}"), F.col(f"rate_{c}")
        aggregates += [
            F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(0, 1)).alias(f"bad_{c}"), (F.avg(c) * 100).alias(f"rate_{c}")
        ]
        rows += [
            _row("flag", c, "outside_domain", bad, _status(bad > 0, "FAIL")),
            _row("flag", c, "rate_percent", rate, _status((rate == 0) | (rate > 80), "WARN")),
        ]
    return aggregates, rows


def check_flags(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values outside {0, 1} fail; a rate of 0 or above 80 percent warns."""
    aggregates, rows = _flags_parts(columns)
    return _rows(table.agg(*aggregates), rows)


def _recency_parts(column: str) -> Parts:
    negative, zeros = F.col(f"negative_{column}"), F.col(f"zeros_{column}")
    return [
        F.count_if(F.col(column) < 0).alias(f"negative_{column}"), _share(F.col(column) == 0).alias(f"zeros_{column}")
    ], [
        _row("recency", column, "negative", negative, _status(negative > 0, "FAIL")),
        _row("recency", column, "zero_percent", zeros, _status(zeros > 50, "FAIL")),
    ]


def check_recency(table: DataFrame, column: str) -> DataFrame:
    """Negative values fail, and so does a share of zeros above 50 percent."""
    aggregates, rows = _recency_parts(column)
    return _rows(table.agg(*aggregates), rows)


def most_common(table: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n most frequent values."""
    return (
        value_counts(table, {column: column}).select("value", "n")
        .orderBy(F.col("n").desc(), "value").limit(n)
    )


def first_values(table: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Counts of the n smallest values."""
    return value_counts(table, {column: column}).select("value", "n").orderBy("value").limit(n)


def _padding_parts(columns: Sequence[str]) -> Parts:
    empty = all_of([F.coalesce(F.col(c) == 0, F.lit(False)) for c in columns])
    return [_share(empty).alias("all_zero")], [
        _row("padding", "", "all_zero_percent", F.col("all_zero"), _status(F.col("all_zero") > 50, "WARN"))
    ]


def check_padding(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows in which every feature is 0 (null is not 0)."""
    aggregates, rows = _padding_parts(columns)
    return _rows(table.agg(*aggregates), rows)


def written_with_checks(table: DataFrame, parts: Sequence[Parts], name: str) -> tuple[DataFrame, DataFrame]:
    """Write the table, and the report rows of some checks observed on the way: they cost no pass of their own."""
    aggregates, rows = [a for p in parts for a in p[0]], [r for p in parts for r in p[1]]
    spark = table.sparkSession
    seen = Observation()
    written = stored(table.observe(seen, *aggregates), name)
    shape = table.limit(0).agg(*aggregates).schema
    one = spark.createDataFrame([tuple(seen.get[f.name] for f in shape)], shape)
    return written, _rows(one, rows)


def check_constant(table: DataFrame, columns: Sequence[str], share: float = 0.95) -> DataFrame:
    """Most frequent value's share of the non-null rows of each column."""
    if not columns:
        return table.sparkSession.createDataFrame([], "check string, column string, metric string, value double, status string")
    counts = heavy_values(table, {c: c for c in columns})
    return counts.withColumn("share", F.col("top") / F.col("n")).select(
        F.lit("constant").alias("check"), F.col("metric").alias("column"),
        F.lit("top_value_percent").alias("metric"), (F.col("share") * 100).alias("value"),
        _status(F.col("share") > share, "WARN").alias("status"),
    )


def user_sample(
    table: DataFrame, columns: Sequence[str], users: int = 3, rows: int = 6, seed: int = 42
) -> DataFrame:
    """First rows and day span of a few users drawn by a seeded hash."""
    chosen = (
        table.where(F.col("user").isNotNull()).groupBy("user")
        .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
             F.count(F.lit(1)).alias("user_rows"))
        .orderBy(seeded_hash("user", seed), "user").limit(users)
    )
    order = Window.partitionBy("user").orderBy("day")
    return (
        table.join(chosen, "user").withColumn("row", F.row_number().over(order))
        .where(F.col("row") <= rows)
        .select("user", "row", "day", *columns, "first_day", "last_day", "user_rows")
    )


def numeric_columns(table: DataFrame) -> list[str]:
    """Names of the numeric columns."""
    return [f.name for f in table.schema.fields if isinstance(f.dataType, T.NumericType)]


def quality_report(table: DataFrame, roles: Mapping[str, Sequence[str]]) -> DataFrame:
    """All checks that give report rows.

    ``roles`` names the columns: ``zscores``, ``flags``, ``recency``, ``required`` and ``padding``. Columns the table
    lacks are reported once and skipped after that. Every numeric column is checked for a dominant value.
    """
    def have(role: str) -> list[str]:
        return [c for c in roles.get(role, ()) if c in table.columns]

    # The table is computed once. What one row of aggregates can say is observed while it is written; the other
    # checks read the columns they need from the written one.
    observed = [_columns_parts(table, roles.get("required", ())), _dates_parts(F.col("day"), (5, 6), 0.05)]
    observed += [_flags_parts(have("flags"))] if have("flags") else []
    observed += [_recency_parts(c) for c in have("recency")]
    observed += [_padding_parts(have("padding"))] if have("padding") else []
    table, said = written_with_checks(table, observed, "quality-table")
    parts = [said, check_shape(table)]
    parts += [check_zscores(table, have("zscores"))] if have("zscores") else []
    parts.append(check_constant(table, numeric_columns(table)))
    return reduce(lambda a, b: a.unionByName(b), parts)
