"""The tables of a report, by name, ready to be written or queried."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.counts import with_remainder
from plumbline.operators.usage import costs_by

# How much the listings show.
LISTED_ANOMALIES = 20
LISTED_CATEGORIES = 3
MESSAGE_LENGTH = 80


def overview_table(profiled: DataFrame, issues: DataFrame, sources: Sequence[str] = ()) -> DataFrame:
    """One row: rows, columns, sources and the number of issues by severity."""
    found = issues.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    errors, warnings = found.select("errors").scalar(), found.select("warnings").scalar()
    return profiled.agg(
        F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count"), F.count("*").alias("column_count")
    ).select(
        "*",
        F.lit(", ".join(sources) or "N/A").alias("sources"),
        errors.alias("validation_errors"),
        warnings.alias("validation_warnings"),
    )


def meta_table(profiled: DataFrame, records: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row: anomaly_count, row_count, anomaly_rate (4 places) and the findings as an array in their order."""
    rows = profiled.agg(F.coalesce(F.max("row_count"), F.lit(0)).alias("n")).scalar()
    told = F.array().cast("array<string>")
    if found is not None:
        listed = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("finding_order", "finding"))), lambda f: f["finding"]).alias("f"))
        told = listed.scalar()
    return records.agg(F.count("*").alias("anomaly_count")).select(
        "anomaly_count",
        rows.alias("row_count"),
        F.round(F.coalesce(F.try_divide(F.col("anomaly_count"), rows), F.lit(0.0)), 4).alias("anomaly_rate"),
        told.alias("findings"),
    )


def schema_table(profiled: DataFrame) -> DataFrame:
    return profiled.select(
        "position",
        "column_name",
        "dtype",
        F.when(F.col("nullable"), "Yes").otherwise("No").alias("nullable"),
        F.format_string("%.1f%%", F.col("null_rate") * 100).alias("null_rate"),
    )


def quality_table(issues: DataFrame) -> DataFrame:
    """Issues with errors first; an issue of the whole table is filed under "Dataset"."""
    rank = F.when(F.col("severity") == "error", 0).otherwise(1)
    return issues.select(
        rank.alias("severity_order"),
        "severity",
        F.coalesce("column_name", F.lit("Dataset")).alias("subject"),
        "message",
        "affected_rows",
    )


def numeric_table(stats: DataFrame) -> DataFrame:
    def shown(name: str) -> Column:
        return F.format_string("%.2f", F.col(name)).alias(name)

    return stats.where(F.col("mean").isNotNull()).select(
        "position",
        "column_name",
        F.format_string("%,d", F.col("count")).alias("count"),
        shown("mean"),
        shown("std"),
        shown("min"),
        F.format_string("%.2f", F.col("p50")).alias("median"),
        shown("max"),
    )


def categorical_table(stats: DataFrame) -> DataFrame:
    top = F.array_join(F.slice("top_values", 1, LISTED_CATEGORIES), ", ")
    return stats.where(F.col("mean").isNull()).select(
        "position",
        "column_name",
        F.format_string("%,d", F.col("count")).alias("count"),
        F.when(F.size("top_values") > 0, top).otherwise("N/A").alias("top_values"),
    )


def anomaly_table(records: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """The first anomalies in key order, each with the number of anomalies not shown."""
    listed = with_remainder(records, [col(k) for k in key_cols], LISTED_ANOMALIES)
    return listed.select(
        *[col(k) for k in key_cols],
        "column_name",
        F.coalesce(F.col("value").cast("string"), F.lit("null")).alias("value"),
        F.format_string("%.4f", F.col("score")).alias("score"),
        "method",
        "not_shown",
    )


def error_table(errors: DataFrame) -> DataFrame:
    """Run errors (agent_id, attempt, error_type, message, recovery_tier) with long messages cut."""
    message = F.col("message")
    cut = F.when(F.length(message) > MESSAGE_LENGTH, F.concat(F.substring(message, 1, MESSAGE_LENGTH), F.lit("...")))
    return errors.select(
        "agent_id",
        "attempt",
        F.concat(F.col("error_type"), F.lit(": "), F.coalesce(cut, message)).alias("error"),
        "recovery_tier",
    )


def report_tables(
    profiled: DataFrame,
    issues: DataFrame,
    stats: DataFrame,
    records: DataFrame,
    key_cols: Sequence[str],
    found: DataFrame | None = None,
    charts: Mapping[str, DataFrame] | None = None,
    usage: DataFrame | None = None,
    errors: DataFrame | None = None,
    sources: Sequence[str] = (),
    listings: bool = False,
) -> dict[str, DataFrame]:
    """All report tables that the given results allow, whole and with plain values.

    ``listings`` adds the formatted and shortened tables that a reader is shown.
    """
    tables = {
        "overview": overview_table(profiled, issues, sources),
        "meta": meta_table(profiled, records, found),
        "schema": profiled,
        "quality": quality_table(issues),
        "stats": stats,
        "anomalies": records,
    }
    if listings:
        tables |= {
            "schema_listing": schema_table(profiled),
            "numeric_listing": numeric_table(stats),
            "categorical_listing": categorical_table(stats),
            "anomaly_listing": anomaly_table(records, key_cols),
        }
        if errors is not None:
            tables["error_listing"] = error_table(errors)
    if found is not None:
        tables["findings"] = found
    for name, data in (charts or {}).items():
        tables[f"chart_{name}"] = data
    if usage is not None:
        tables["cost_by_agent"] = costs_by(usage, "agent_id")
        tables["cost_by_model"] = costs_by(usage, "model")
    if errors is not None:
        tables["errors"] = errors
    return tables
