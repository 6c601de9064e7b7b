"""Registration of named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            CHECKS[function.__name__] = sql
        return function
    return add


# Minutes are whole microseconds over 60 million: at eight places none lies on a tie.
MINUTES = {"minutes": 8, "total_active_minutes_day": 8}


def rounded(table: DataFrame, places: int = 6) -> DataFrame:
    """Round every double, as the checking SQL does."""
    doubles = [f.name for f in table.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not doubles:
        return table
    return table.withColumns({c: F.round(c, MINUTES.get(c, places)) for c in doubles})
