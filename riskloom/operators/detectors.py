"""The unsupervised stage: both detectors on one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import DetectorSettings
from riskloom.operators.envelope import EnvelopeModel, fit_envelope
from riskloom.operators.isolation import IsolationModel, fit_isolation


def unsupervised(
    table: DataFrame, features: Sequence[str], settings: DetectorSettings = DetectorSettings()
) -> tuple[IsolationModel, EnvelopeModel, DataFrame]:
    """Isolation forest on all rows, envelope fitted on unlabelled rows and applied to all."""
    isolation, scored = fit_isolation(table, features, settings=settings)
    envelope = fit_envelope(scored.where(F.col("insider_label") == 0), features, settings)
    return isolation, envelope, envelope.transform(scored)
