"""One record per run, built from the run table and the logs around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how many runs a listing shows.
LISTED_RUNS = 100


def _costs(usage: DataFrame) -> DataFrame:
    return usage.groupBy("task_id").agg(
        F.sum("cost_usd").alias("total_cost_usd"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
    )


def run_rollup(
    runs: DataFrame,
    issues: DataFrame,
    anomalies: DataFrame,
    usage: DataFrame,
    errors: DataFrame,
    charts: DataFrame | None = None,
    found: DataFrame | None = None,
    by_agent: bool = False,
) -> DataFrame:
    """Every run with its counts of issues, anomalies and errors and its usage totals.

    ``runs`` has task_id, status, row_count and further columns, which are
    kept. Each log is summed per task before it is joined, so a task that
    produced much of a log meets the join as one row. With ``by_agent``
    ``cost_by_agent`` maps agents to their cost. ``charts`` (task_id) adds chart_count, ``found``
    (task_id, finding_order, finding) adds key_findings in their order.
    """
    issue_counts = issues.groupBy("task_id").agg(
        F.count_if(F.col("severity") == "error").alias("validation_error_count"),
        F.count_if(F.col("severity") == "warning").alias("validation_warning_count"),
    )
    anomaly_counts = anomalies.groupBy("task_id").agg(F.count("*").alias("anomaly_count"))
    error_counts = errors.groupBy("task_id").agg(F.count("*").alias("error_count"))
    parts = [issue_counts, anomaly_counts, error_counts, _costs(usage)]
    if by_agent:
        spent = usage.groupBy("task_id", "agent_id").agg(F.round(F.sum("cost_usd"), 6).alias("cost")).groupBy("task_id")
        parts.append(spent.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent_id", "cost")))).alias("cost_by_agent")))
    if charts is not None:
        parts.append(charts.groupBy("task_id").agg(F.count("*").alias("chart_count")))
    if found is not None:
        told = F.transform(F.array_sort(F.collect_list(F.struct("finding_order", "finding"))), lambda f: f["finding"])
        parts.append(found.groupBy("task_id").agg(told.alias("key_findings")))
    joined = runs
    for part in parts:
        joined = joined.join(part, "task_id", "left")
    counts = (
        "validation_error_count",
        "validation_warning_count",
        "anomaly_count",
        "error_count",
        "total_input_tokens",
        "total_output_tokens",
    )
    rate = F.coalesce(F.try_divide(F.col("anomaly_count"), F.col("row_count")), F.lit(0.0))
    return (
        joined.fillna(0, [*counts, *(["chart_count"] if charts is not None else [])])
        .withColumn("total_cost_usd", F.round(F.coalesce("total_cost_usd", F.lit(0.0)), 6))
        .withColumn("anomaly_rate", F.round(rate, 4))
    )


def recent_runs(runs: DataFrame, usage: DataFrame, limit: int = LISTED_RUNS) -> DataFrame:
    """The newest runs first, with their cost. The listing is cut before the log is joined."""
    newest = runs.orderBy(F.desc("stored_at"), F.desc("task_id")).limit(limit)
    costs = _costs(usage).select("task_id", "total_cost_usd")
    return (
        newest.join(costs, "task_id", "left")
        .withColumn("total_cost_usd", F.round(F.coalesce("total_cost_usd", F.lit(0.0)), 6))
        .orderBy(F.desc("stored_at"), F.desc("task_id"))
    )
