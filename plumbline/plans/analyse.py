"""Statistics, anomalies, chart data and findings of one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline.errors import InsufficientData
from plumbline.operators.anomalies import DetectionSettings, detect, empty_records
from plumbline.operators.charts import MAX_CHARTS, MAX_POINTS, auto_charts
from plumbline.operators.findings import findings
from plumbline.operators.statistics import compute_stats
from plumbline.session import materialize

# Charts of an analysis without anomalies, and the tiers.
CHARTS_WITHOUT_DETECTION = 2
FULL, DEGRADED = "none", "degraded"


@dataclass(frozen=True)
class Analysed:
    stats: DataFrame
    records: DataFrame
    charts: dict[str, DataFrame]
    findings: DataFrame
    tier: str
    warning: str | None = None


def analyse(
    df: DataFrame,
    key_cols: Sequence[str],
    settings: DetectionSettings = DetectionSettings(),
    bucket: str | None = None,
    normal_share: float | None = None,
    max_points: int | None = MAX_POINTS,
) -> Analysed:
    """Analyse a table. With too few rows for detection the statistics still come.

    Chart data is bounded by ``max_points`` unless that is None, ``bucket`` or ``normal_share`` is given.

    Anomaly records are written once, since charts and findings read them again.
    """
    stats = compute_stats(df)
    warning = None
    try:
        found = detect(df, key_cols, settings=settings)
        records, tier, max_charts = materialize(found.records), FULL, MAX_CHARTS
    except InsufficientData as error:
        records, tier, max_charts = empty_records(df, key_cols), DEGRADED, CHARTS_WITHOUT_DETECTION
        warning = str(error)
    points = max_points if bucket is None and normal_share is None else None
    charts = auto_charts(df, key_cols, records, max_charts, bucket, normal_share, max_points=points)
    return Analysed(stats, records, charts, findings(stats, records, key_cols), tier, warning)
