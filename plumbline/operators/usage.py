"""Cost of model calls: price lookup, totals and scenario comparison over usage logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.usage import call_cost, model_name, token_counts

# The scenarios that comparisons are made against.
BASELINE_SCENARIO = "all_large"
MIXED_SCENARIO = "mixed_routing"


def usage_from_metadata(raw: DataFrame, column: str) -> DataFrame:
    """Add model, input_tokens and output_tokens read from a column of raw JSON metadata."""
    tokens = token_counts(F.col(column))
    return raw.select(
        "*", model_name(F.col(column)).alias("model"), tokens.alias("__t")
    ).select("*", "__t.*").drop("__t")


def price_calls(usage: DataFrame, prices: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Add ``cost_usd`` to a usage log; unknown models cost 0.

    ``prices`` has model, input_price and output_price per million tokens;
    ``aliases`` has alias and model. Both are plain joins: Spark broadcasts
    them when they are small.
    """
    priced = usage
    if aliases is not None:
        names = aliases.select(F.col("alias").alias("model"), F.col("model").alias("__model"))
        priced = priced.join(names, "model", "left")
        priced = priced.withColumn("__model", F.coalesce("__model", "model"))
    else:
        priced = priced.withColumn("__model", F.col("model"))
    listed = prices.select(F.col("model").alias("__model"), "input_price", "output_price")
    return priced.join(listed, "__model", "left").select(
        *usage.columns,
        call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_price"), F.col("output_price")).alias(
            "cost_usd"
        ),
    )


_TOTALS = (
    ("calls", F.count, "*"),
    ("input_tokens", F.sum, "input_tokens"),
    ("output_tokens", F.sum, "output_tokens"),
    ("cost_usd", F.sum, "cost_usd"),
    ("latency_ms", F.sum, "latency_ms"),
)


def _totals():
    return [function(column).alias(name) for name, function, column in _TOTALS]


def cost_breakdown(usage: DataFrame) -> DataFrame:
    """Totals per task, per agent of a task and per model of a task, from one pass.

    Columns: task_id, agent_id, model (null where summed over), then calls,
    tokens, cost_usd and latency_ms.
    """
    task, agent, model = F.col("task_id"), F.col("agent_id"), F.col("model")
    return usage.groupingSets(
        [[task], [task, agent], [task, model]],
        task,
        agent,
        model,
    ).agg(*_totals())


def task_totals(usage: DataFrame) -> DataFrame:
    """Totals per task: calls, tokens, cost_usd, latency_ms."""
    return usage.groupBy("task_id").agg(*_totals())


def agent_totals(usage: DataFrame) -> DataFrame:
    """Totals per agent of a task, cost to 6 places and latency to 1."""
    return (
        usage.groupBy("task_id", "agent_id")
        .agg(*_totals())
        .withColumns({"cost_usd": F.round("cost_usd", 6), "latency_ms": F.round("latency_ms", 1)})
    )


def costs_by(usage: DataFrame, column: str) -> DataFrame:
    """Cost per agent or per model of the whole log, dearest first."""
    return usage.groupBy(column).agg(F.sum("cost_usd").alias("cost_usd")).orderBy(F.desc("cost_usd"), column)


def scenario_costs(tokens: DataFrame, scenarios: DataFrame, prices: DataFrame) -> DataFrame:
    """Estimated cost of each scenario: (scenario, agent_id, model, cost_usd).

    ``tokens`` has agent_id, input_tokens, output_tokens; ``scenarios`` has
    scenario, agent_id, model. Agents without tokens cost 0.
    """
    used = scenarios.join(tokens, "agent_id", "left").fillna(0, ["input_tokens", "output_tokens"])
    return price_calls(used, prices).select("scenario", "agent_id", "model", "cost_usd")


def scenario_totals(costs: DataFrame) -> DataFrame:
    """(scenario, estimated_cost_usd) to 6 places."""
    return costs.groupBy("scenario").agg(F.round(F.sum("cost_usd"), 6).alias("estimated_cost_usd"))


def compare_scenarios(runs: DataFrame) -> DataFrame:
    """Mean cost and latency per scenario, and the ratio to the baseline scenario.

    ``runs`` has scenario, status, cost_usd, latency_ms. Cost is averaged over
    runs that did not fail, latency over all. The ratio is null without a
    positive baseline or cost. ``saved_percent`` is 100 * (1 - ratio).
    """
    means = runs.groupBy("scenario").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") != "failed").alias("successful_runs"),
        F.round(F.coalesce(F.avg(F.when(F.col("status") != "failed", F.col("cost_usd"))), F.lit(0.0)), 6).alias(
            "avg_cost_usd"
        ),
        F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"),
    )
    baseline = means.agg(F.max(F.when(F.col("scenario") == BASELINE_SCENARIO, F.col("avg_cost_usd")))).scalar()
    ratio = F.when((baseline > 0) & (F.col("avg_cost_usd") > 0), F.col("avg_cost_usd") / baseline)
    return means.select(
        "*", F.round(ratio, 2).alias("cost_ratio"), F.round((1 - ratio) * 100, 0).alias("saved_percent")
    )
