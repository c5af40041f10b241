"""Score runs against expectations and summarise the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import missing_sections, strip

# Weights, deductions and thresholds of the score.
SCHEMA_WEIGHT, ANALYSIS_WEIGHT, REPORT_WEIGHT = 0.30, 0.40, 0.30
SCHEMA_STEP, ANALYSIS_STEP, REPORT_STEP = 0.25, 0.33, 0.25
PASS_SCORE = 0.60
SHORT_REPORT, SHORT_REPORT_STEPS = 50, 2

# What an expectation says when it leaves a field out.
DEFAULTS = {"min_rows": 0, "max_anomaly_rate": 1.0, "min_anomaly_count": 0, "min_word_count": 0}
LIST_FIELDS = ("required_columns", "required_report_sections")
EXPECTATION_FIELDS = (
    "min_rows",
    "max_rows",
    "required_columns",
    "max_anomaly_rate",
    "min_anomaly_count",
    "required_report_sections",
    "min_word_count",
)


def read_expectations(fixtures: DataFrame, column: str = "expected") -> DataFrame:
    """Expectation fields, with defaults, from rows (task_id, <struct column of a JSON fixture>).

    The struct need not have every field.
    """
    fields = set(fixtures.schema[column].dataType.names)
    types = {
        "min_rows": "bigint",
        "max_rows": "bigint",
        "max_anomaly_rate": "double",
        "min_anomaly_count": "bigint",
        "min_word_count": "bigint",
    }
    out = []
    for name in EXPECTATION_FIELDS:
        kind = types.get(name, "array<string>")
        value = F.col(column)[name].cast(kind) if name in fields else F.lit(None).cast(kind)
        out.append(value.alias(name))
    return fixtures.select("task_id", *out)


def _listed(names: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def score_runs(runs: DataFrame, expectations: DataFrame, pass_score: float = PASS_SCORE) -> DataFrame:
    """One row per run: part scores, total_score, passed and the list of failures.

    ``runs`` has task_id, has_etl, row_count, columns, has_analysis,
    anomaly_rate, anomaly_count, stats_count, has_report, content, word_count.
    A run without an expectation is held to the defaults.
    """
    joined = runs.join(expectations, "task_id", "left")
    for name in EXPECTATION_FIELDS:
        if name in DEFAULTS:
            joined = joined.withColumn(name, F.coalesce(name, F.lit(DEFAULTS[name])))
        elif name in LIST_FIELDS:
            joined = joined.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))

    c = F.col
    content = F.coalesce(c("content"), F.lit(""))
    absent_columns = F.filter("required_columns", lambda n: ~F.array_contains(F.coalesce(c("columns"), F.array().cast("array<string>")), n))
    joined = joined.withColumns(
        {"__columns": absent_columns, "__sections": missing_sections(content, c("required_report_sections"))}
    )

    # The failure formats. Each check is (fails, points lost, message).
    schema_checks = [
        (
            c("row_count") < c("min_rows"),
            F.lit(1),
            F.format_string("Row count %d < required %d", c("row_count"), c("min_rows")),
        ),
        (
            (c("max_rows") != 0) & (c("row_count") > c("max_rows")),
            F.lit(1),
            F.format_string("Row count %d > max %d", c("row_count"), c("max_rows")),
        ),
        (
            F.size("__columns") > 0,
            F.size("__columns"),
            F.concat(F.lit("Missing required columns: "), _listed(c("__columns"))),
        ),
    ]
    analysis_checks = [
        (
            c("anomaly_rate") > c("max_anomaly_rate"),
            F.lit(1),
            F.format_string("Anomaly rate %.2f%% > max %.2f%%", c("anomaly_rate") * 100, c("max_anomaly_rate") * 100),
        ),
        (
            c("anomaly_count") < c("min_anomaly_count"),
            F.lit(1),
            F.format_string("Detected %d anomalies, expected >= %d", c("anomaly_count"), c("min_anomaly_count")),
        ),
        (c("stats_count") == 0, F.lit(1), F.lit("No summary statistics generated")),
    ]
    report_checks = [
        (
            F.size("__sections") > 0,
            F.size("__sections"),
            F.concat(F.lit("Missing report sections: "), _listed(c("__sections"))),
        ),
        (
            c("word_count") < c("min_word_count"),
            F.lit(1),
            F.format_string("Report word count %d < required %d", c("word_count"), c("min_word_count")),
        ),
        (
            F.length(strip(content)) < SHORT_REPORT,
            F.lit(SHORT_REPORT_STEPS),
            F.lit("Report content appears empty or too short"),
        ),
    ]
    parts = (
        ("schema_score", "has_etl", "ETL result missing", schema_checks, SCHEMA_STEP),
        ("analysis_score", "has_analysis", "Analysis result missing", analysis_checks, ANALYSIS_STEP),
        ("report_score", "has_report", "Report result missing", report_checks, REPORT_STEP),
    )
    # Each check is worked out once, then read by the scores and by the list of failures.
    checks = [check for _, _, _, part, _ in parts for check in part]
    flags = {f"__fails{i}": F.coalesce(fails, F.lit(False)) for i, (fails, _, _) in enumerate(checks)}
    joined = joined.withColumns(flags)
    place = {id(check): c(f"__fails{i}") for i, check in enumerate(checks)}
    scores, failures = {}, []
    for name, present, missing, part, step in parts:
        lost = F.lit(0)
        for check in part:
            lost = lost + F.when(place[id(check)], check[1]).otherwise(0)
        scored = F.round(F.greatest(F.lit(0.0), F.lit(1.0) - lost * F.lit(step)), 4)
        scores[name] = F.when(c(present), scored).otherwise(0.0)
        failures.append(F.when(~c(present), F.lit(missing)))
        failures += [F.when(c(present) & place[id(check)], check[2]) for check in part]
    return (
        joined.withColumns({**scores, "failures": F.array_compact(F.array(*failures))})
        .withColumn(
            "total_score",
            F.round(
                c("schema_score") * SCHEMA_WEIGHT
                + c("analysis_score") * ANALYSIS_WEIGHT
                + c("report_score") * REPORT_WEIGHT,
                4,
            ),
        )
        .select(
            "task_id",
            "schema_score",
            "analysis_score",
            "report_score",
            "total_score",
            (c("total_score") >= F.lit(pass_score)).alias("passed"),
            "failures",
        )
    )


def completion_rate(status: Column) -> Column:
    """Aggregate: share of runs that are complete or partial, to 4 places; 0 without runs."""
    return F.round(F.coalesce(F.avg(status.isin("complete", "partial").cast("double")), F.lit(0.0)), 4)


def summarise_runs(results: DataFrame) -> DataFrame:
    """One row over rows (status, correctness_score, cost_usd, latency_ms, passed); zeros for no runs."""

    def mean(name: str, places: int) -> Column:
        return F.round(F.coalesce(F.avg(F.coalesce(name, F.lit(0.0))), F.lit(0.0)), places)

    status = F.coalesce("status", F.lit("failed"))
    return results.agg(
        F.count("*").alias("total_tasks"),
        completion_rate(status).alias("completion_rate"),
        mean("correctness_score", 4).alias("avg_correctness"),
        mean("cost_usd", 6).alias("avg_cost_usd"),
        mean("latency_ms", 1).alias("avg_latency_ms"),
        F.count_if(F.coalesce("passed", F.lit(False))).alias("passed_count"),
        F.count_if(status == "failed").alias("failed_count"),
        F.count_if(status == "partial").alias("partial_count"),
    )
