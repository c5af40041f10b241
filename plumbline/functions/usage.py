"""Expressions over raw usage metadata of model calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Places where providers put the model name and the token counts.
MODEL_PATHS = ("$.llm_output.model", "$.llm_output.model_id", "$.generation_info.model")
USAGE_PATHS = ("$.llm_output.usage", "$.llm_output.token_usage")
INPUT_FIELDS = ("input_tokens", "prompt_tokens")
OUTPUT_FIELDS = ("output_tokens", "completion_tokens")
FALLBACK_USAGE_PATH = "$.generation_info.usage"
UNKNOWN_MODEL = "unknown"


def model_name(raw: Column) -> Column:
    """First non-blank model name in the metadata, else "unknown"."""
    found = [F.nullif(F.get_json_object(raw, path), F.lit("")) for path in MODEL_PATHS]
    return F.coalesce(*found, F.lit(UNKNOWN_MODEL))


def _count(raw: Column, path: str) -> Column:
    """A positive token count at ``path``; zero and absent are both null."""
    number = F.get_json_object(raw, path).try_cast("bigint")
    return F.when(number != 0, number)


def token_counts(raw: Column) -> Column:
    """Struct (input_tokens, output_tokens) from either provider layout.

    The usage block of the response decides; only if it yields no tokens at all
    does the block of the first generation count.
    """
    block = F.when(F.get_json_object(raw, USAGE_PATHS[0]).isin("{}", ""), None).otherwise(
        F.get_json_object(raw, USAGE_PATHS[0])
    )
    block = F.coalesce(block, F.get_json_object(raw, USAGE_PATHS[1]))
    tokens_in = F.coalesce(*[_count(block, f"$.{f}") for f in INPUT_FIELDS], F.lit(0))
    tokens_out = F.coalesce(*[_count(block, f"$.{f}") for f in OUTPUT_FIELDS], F.lit(0))
    none_found = (tokens_in == 0) & (tokens_out == 0)
    later_in = F.coalesce(_count(raw, f"{FALLBACK_USAGE_PATH}.{INPUT_FIELDS[0]}"), F.lit(0))
    later_out = F.coalesce(_count(raw, f"{FALLBACK_USAGE_PATH}.{OUTPUT_FIELDS[0]}"), F.lit(0))
    return F.struct(
        F.when(none_found, later_in).otherwise(tokens_in).cast("bigint").alias("input_tokens"),
        F.when(none_found, later_out).otherwise(tokens_out).cast("bigint").alias("output_tokens"),
    )


def call_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Cost of a call from prices per million tokens, rounded to 8 places; 0 without a price."""
    cost = input_tokens / F.lit(1e6) * input_price + output_tokens / F.lit(1e6) * output_price
    return F.coalesce(F.round(cost, 8), F.lit(0.0))
