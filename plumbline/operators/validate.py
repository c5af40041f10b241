"""Data-quality checks. All of them always run; each finding is one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import canonical_type, col, groupable, numeric_columns, type_name
from plumbline.session import small_table

ISSUE_SCHEMA = (
    "check_order int, position int, check_name string, column_name string, "
    "severity string, message string, affected_rows bigint"
)
CHECKS = ("structure", "nulls", "required_columns", "expected_types", "numeric_ranges", "duplicates")


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the checks, with defaults that need no knowledge of the table."""

    min_rows: int = 1
    max_null_rate: float = 0.50
    error_null_rate: float = 1.0
    max_duplicate_rate: float = 0.10
    null_thresholds: Mapping[str, float] = field(default_factory=dict)
    expected_types: Mapping[str, str] = field(default_factory=dict)
    numeric_ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    required_columns: Sequence[str] = ()


def _issue(check: str, position: int, column: str | None, severity: str, message: Column, affected: Column) -> Column:
    return F.struct(
        F.lit(CHECKS.index(check)).alias("check_order"),
        F.lit(position).alias("position"),
        F.lit(check).alias("check_name"),
        F.lit(column).cast("string").alias("column_name"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        affected.cast("bigint").alias("affected_rows"),
    )


def validate(df: DataFrame, rules: QualityRules = QualityRules(), checks: Sequence[str] = CHECKS) -> DataFrame:
    """All findings of the chosen checks.

    One aggregate pass feeds the structure, null and range checks; the
    duplicate check adds one shuffle.
    """
    found = _one_pass_checks(df, rules, checks)
    if "duplicates" in checks and df.columns:
        found = found.unionByName(_duplicate_check(df, rules))
    return found


def quick_validate(
    df: DataFrame, required_columns: Sequence[str] = (), max_null_rate: float = 0.50
) -> DataFrame:
    """The full battery with only the two most used settings."""
    return validate(df, QualityRules(required_columns=tuple(required_columns), max_null_rate=max_null_rate))


def _one_pass_checks(df: DataFrame, rules: QualityRules, checks: Sequence[str]) -> DataFrame:
    rows = F.col("rows")
    measures: list[Column] = [F.count("*").alias("rows")]
    issues: list[Column] = []

    # The message formats of every check below.
    if "structure" in checks:
        empty = _issue("structure", 0, None, "error", F.lit("DataFrame is empty (0 rows)"), F.lit(0))
        few = _issue(
            "structure",
            1,
            None,
            "warning",
            F.format_string("Only %d rows — expected at least %d", rows, F.lit(rules.min_rows)),
            rows,
        )
        issues.append(F.when(rows == 0, empty).when(rows < rules.min_rows, few))
        if not df.columns:
            issues.append(_issue("structure", 2, None, "error", F.lit("DataFrame has no columns"), F.lit(0)))

    if "nulls" in checks:
        for i, name in enumerate(df.columns):
            measures.append((F.count("*") - F.count(col(name))).alias(f"nulls_{i}"))
            nulls = F.col(f"nulls_{i}")
            rate = F.try_divide(nulls, rows)
            limit = float(rules.null_thresholds.get(name, rules.max_null_rate))
            whole = _issue(
                "nulls",
                i,
                name,
                "error",
                F.format_string("Column entirely null (%d/%d rows)", nulls, rows),
                nulls,
            )
            high = _issue(
                "nulls",
                i,
                name,
                "warning",
                F.format_string("%.1f%% null values exceed threshold (%.0f%%)", rate * 100, F.lit(limit * 100)),
                nulls,
            )
            issues.append(F.when(rate >= float(rules.error_null_rate), whole).when(rate > limit, high))

    if "required_columns" in checks:
        for i, name in enumerate(rules.required_columns):
            if name not in df.columns:
                text = F.lit(f"Required column '{name}' is missing from DataFrame")
                issues.append(_issue("required_columns", i, name, "error", text, F.lit(0)))

    if "expected_types" in checks:
        actual = {f.name: type_name(f.dataType) for f in df.schema.fields}
        for i, (name, wanted) in enumerate(rules.expected_types.items()):
            if name in actual and canonical_type(wanted) != canonical_type(actual[name]):
                text = F.lit(f"Expected dtype '{wanted}', got '{actual[name]}'")
                issues.append(_issue("expected_types", i, name, "warning", text, F.lit(0)))

    if "numeric_ranges" in checks:
        numeric = set(numeric_columns(df))
        for i, (name, (low, high)) in enumerate(rules.numeric_ranges.items()):
            if name not in numeric:
                continue
            measures.append(F.count_if(col(name) < low).alias(f"below_{i}"))
            measures.append(F.count_if(col(name) > high).alias(f"above_{i}"))
            sides = (
                (2 * i, f"below_{i}", "%d values below expected minimum (%s)", low),
                (2 * i + 1, f"above_{i}", "%d values above expected maximum (%s)", high),
            )
            for position, measure, layout, bound in sides:
                n = F.col(measure)
                text = F.format_string(layout, n, F.lit(str(bound)))
                issues.append(F.when(n > 0, _issue("numeric_ranges", position, name, "warning", text, n)))

    if not issues:
        return small_table(df.sparkSession, [], ISSUE_SCHEMA)
    return df.agg(*measures).select(F.inline(F.array_compact(F.array(*issues))))


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row (rows, distinct_rows).

    Rows are first counted by two hashes, which is all that is shuffled; equal
    hashes meet in their own task first. Only rows whose hashes occur more than
    once are then compared value by value.
    """
    keys = [groupable(f.name, f.dataType).alias(f"k{i}") for i, f in enumerate(df.schema.fields)]
    names = [f"k{i}" for i in range(len(keys))]
    hashed = df.select(*keys).withColumns({"h1": F.xxhash64(*names), "h2": F.xxhash64(F.lit(1), *names)})
    groups = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    counted = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") == 1).alias("single"))
    again = hashed.join(groups.where("n > 1").select("h1", "h2"), ["h1", "h2"], "left_semi")
    different = again.groupBy(*names).agg(F.lit(1).alias("one")).agg(F.count("*").alias("d")).scalar()
    return counted.select("rows", (F.col("single") + different).alias("distinct_rows"))


def _duplicate_check(df: DataFrame, rules: QualityRules) -> DataFrame:
    rows = F.col("rows")
    extra = rows - F.col("distinct_rows")
    rate = F.try_divide(extra, rows)
    text = F.format_string("%.1f%% duplicate rows (%d/%d)", rate * 100, extra, rows)
    found = F.when(
        (rows >= 2) & (rate > float(rules.max_duplicate_rate)),
        _issue("duplicates", 0, None, "warning", text, extra),
    )
    return duplicate_counts(df).select(F.inline(F.array_compact(F.array(found))))
