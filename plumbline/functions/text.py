"""Expressions over markdown and model-response text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col

# White space, markdown syntax that does not count as words, and the code-fence layouts.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
MARKUP = "#*`|_-"
CODE_BLOCK_PATTERN = r"(?s)```.*?```"
OPENING_FENCE_PATTERN = r"(?m)^```(?:json)?\s*"
CLOSING_FENCE_PATTERN = r"(?m)\s*```\s*$"
SECTION_BREAK = "\n## "
LEADING_SECTION = "Header"


def word_count(text: Column) -> Column:
    """Words outside fenced code, with markdown syntax treated as space."""
    plain = F.regexp_replace(text, CODE_BLOCK_PATTERN, "")
    separators = MARKUP + SPACES
    apart = F.translate(plain, separators, " " * len(separators))
    words = F.regexp_count(apart, F.lit("[^ ]+"))
    return F.coalesce(words, F.lit(0)).cast("bigint")


def sections(df: DataFrame, key_cols: Sequence[str], text_col: str) -> DataFrame:
    """One row per level-2 section: key columns, section_order, title, content.

    The part before the first heading is section 0 and is titled "Header".
    """
    keys = [col(k) for k in key_cols]
    parts = F.split(col(text_col), SECTION_BREAK)
    rows = df.select(*keys, F.posexplode(parts).alias("section_order", "part"))
    cut = F.locate("\n", F.col("part"))
    heading = F.when(cut > 0, F.expr("substring(part, 1, locate('\n', part) - 1)")).otherwise(F.col("part"))
    body = F.when(cut > 0, F.expr("substring(part, locate('\n', part) + 1)")).otherwise(F.lit(""))
    first = F.col("section_order") == 0
    return rows.select(
        *keys,
        "section_order",
        F.when(first, LEADING_SECTION).otherwise(strip(heading)).alias("title"),
        strip(F.when(first, F.col("part")).otherwise(body)).alias("content"),
    )


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def missing_sections(content: Column, required: Column) -> Column:
    """The entries of the array ``required`` that ``content`` does not contain, ignoring case."""
    lowered = F.lower(F.coalesce(content, F.lit("")))
    return F.filter(required, lambda name: ~F.contains(lowered, F.lower(name)))


def strip_fences(content: Column) -> Column:
    """Remove markdown code fences around a model response."""
    opened = F.regexp_replace(content, OPENING_FENCE_PATTERN, "")
    return strip(F.regexp_replace(opened, CLOSING_FENCE_PATTERN, ""))


def parse_json_object(df: DataFrame, content_col: str) -> DataFrame:
    """Add ``payload`` (variant, null if unusable) and ``parse_error`` (null if fine).

    A response must be one JSON object once code fences are gone.
    """
    cleaned = strip_fences(col(content_col))
    payload = F.try_parse_json(cleaned)
    kind = F.schema_of_variant(payload)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    return df.select(
        "*",
        F.when(is_object, payload).alias("payload"),
        F.when(cleaned.isNull() | payload.isNull(), F.lit("invalid JSON"))
        .when(~is_object, F.concat(F.lit("expected a JSON object, got "), kind))
        .alias("parse_error"),
    )


def parse_json_list(df: DataFrame, content_col: str) -> DataFrame:
    """Add ``items`` (array of text, blanks dropped; empty if the response is not a JSON array)."""
    cleaned = strip_fences(col(content_col))
    payload = F.try_parse_json(cleaned)
    is_list = F.coalesce(F.schema_of_variant(payload).startswith("ARRAY"), F.lit(False))
    entries = F.try_variant_get(payload, "$", "array<variant>")
    texts = F.transform(entries, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    kept = F.filter(texts, lambda t: t.isNotNull() & (t != "") & (t != "null"))
    empty = F.array().cast("array<string>")
    return df.select("*", F.when(is_list, kept).otherwise(empty).alias("items"))
