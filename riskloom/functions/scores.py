"""Score, tier and coercion expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keeps a range of zero width from dividing by zero.
EPSILON = 1e-9


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null (``least`` and ``greatest`` skip nulls)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def inverted_share(value: Column, low: Column, high: Column) -> Column:
    """1 at the low end and 0 at the high end; 0 everywhere when the range is empty."""
    return F.when(high == low, F.lit(0.0)).otherwise(1 - (value - low) / (high - low))


def anchored_share(value: Column, low: Column, high: Column) -> Column:
    """Like ``inverted_share`` against a given range, bounded to [0, 1]."""
    return clip(1 - (value - low) / (high - low + EPSILON), 0.0, 1.0)


def range_share(value: Column, low: Column, high: Column) -> Column:
    """0 at the low end and almost 1 at the high end."""
    return (value - low) / (high - low + EPSILON)


def risk_tier(score: Column) -> Column:
    """Tier of a score; anything below 0.40, null included, is medium."""
    return F.when(score >= 0.75, "critical").when(score >= 0.40, "high").otherwise("medium")


def to_int(value: Column) -> Column:
    """Whole number via double, cut towards zero; what does not parse, or exceeds 64 bits, is 0."""
    number = value.cast("string").try_cast("double")
    return F.coalesce(number.try_cast("bigint"), F.lit(0))


def to_strict_int(value: Column) -> Column:
    """Whole number from integer text only; '3.9' and what does not parse are 0."""
    return F.coalesce(F.trim(value.cast("string")).try_cast("bigint"), F.lit(0))


def to_double(value: Column) -> Column:
    """Double; what does not parse is 0."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def is_flagged(prediction: Column) -> Column:
    """True when a detector called the row an outlier (-1)."""
    return prediction == -1


def both_flagged(first: Column, second: Column) -> Column:
    """1 when both detectors flag the row."""
    return F.coalesce(is_flagged(first) & is_flagged(second), F.lit(False)).cast("int")


def above(score: Column, threshold: Column | float) -> Column:
    """1 when the score reaches the threshold."""
    return F.coalesce(score >= threshold, F.lit(False)).cast("int")
