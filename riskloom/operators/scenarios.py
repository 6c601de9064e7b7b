"""Tag user-days that look like a known incident scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (low, high) bounds per scenario, both included, and the z-score range.
SIGNATURES = {
    1: {"after_hours_session_count": (2, 5), "usb_count": (3, 7), "usb_after_hours_flag": (1, 1),
        "job_site_visits_flag": (0, 0), "job_search_plus_usb_week": (0, 0)},
    2: {"job_site_visits_flag": (1, 1), "usb_count": (4, 9), "job_search_plus_usb_week": (1, 1),
        "after_hours_session_count": (0, 1)},
    3: {"after_hours_session_count": (3, 6), "usb_count": (2, 4), "usb_after_hours_flag": (1, 1),
        "job_site_visits_flag": (0, 0)},
}
ZSCORE_RANGES = {1: (2.5, 4.5), 2: (2.0, 4.0), 3: (1.5, 3.5)}


def with_scenarios(table: DataFrame, with_zscore: bool = False) -> DataFrame:
    """Add ``scenarios``, the signatures a day fits; a day can fit several."""
    matches = []
    for number, bounds in SIGNATURES.items():
        fits = F.lit(True)
        for column, (low, high) in bounds.items():
            fits = fits & F.col(column).between(low, high)
        if with_zscore:
            fits = fits & F.col("usb_count_zscore").between(*ZSCORE_RANGES[number])
        matches.append(F.when(fits, F.lit(number)))
    return table.withColumn("scenarios", F.array_compact(F.array(*matches)))
