"""Load sources, merge them, fix types, and describe and check the result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import LoadError
from plumbline.operators.casts import apply_casts, suggest_casts
from plumbline.operators.merge import merge
from plumbline.operators.profile import profile, profile_issues
from plumbline.operators.validate import QualityRules, validate
from plumbline.sources.readers import FULL, Loaded, load_with_status
from plumbline.sources.spec import SourceSpec

_ISSUE_COLUMNS = ("column_name", "severity", "message", "affected_rows")


@dataclass(frozen=True)
class Ingested:
    data: DataFrame
    profile: DataFrame
    issues: DataFrame
    status: DataFrame


def describe(df: DataFrame, rules: QualityRules = QualityRules()) -> tuple[DataFrame, DataFrame]:
    """The profile of a table and all its issues."""
    profiled = profile(df)
    issues = profile_issues(profiled).select(*_ISSUE_COLUMNS)
    return profiled, issues.unionByName(validate(df, rules).select(*_ISSUE_COLUMNS))


def ingest(
    spark: SparkSession,
    sources: Sequence[SourceSpec],
    rules: QualityRules = QualityRules(),
    orders: Sequence[Sequence[str]] | None = None,
    on_error: str = "raise",
) -> Ingested:
    """Run the whole load. ``orders`` fixes row orders where tables go side by side.

    A source that cannot be read is an error, as the result would look whole
    without it; with ``on_error="skip"`` it is left out, and the status says so.
    """
    loaded: Loaded = load_with_status(spark, sources)
    if on_error != "skip":
        failed = loaded.status.where(F.col("tier") != FULL).select("source_id", "warning").collect()
        if failed:
            raise LoadError("; ".join(f"{r.source_id}: {r.warning}" for r in failed))
    data = merge(list(loaded.frames.values()), orders, spark)
    data = apply_casts(data, suggest_casts(data))
    profiled, issues = describe(data, rules)
    return Ingested(data, profiled, issues, loaded.status)
