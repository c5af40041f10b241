"""Expressions that recognise and convert values held as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value in delimited files.
NULL_TOKENS = ("", "NULL", "null", "N/A", "n/a", "NA", "na", "None", "none", "-")

# Texts that a boolean column may hold, compared trimmed and in lower case.
TRUE_WORDS = ("true", "yes", "1", "t", "y", "on")
FALSE_WORDS = ("false", "no", "0", "f", "n", "off")

# Patterns of whole numbers, numbers and the accepted date layouts.
INTEGER_PATTERN = r"^\s*-*[0-9]+\s*$"
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE_LAYOUTS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
)
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"


def blank_to_null(value: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Null where the text is one of ``tokens`` exactly."""
    return F.when(~value.isin(*tokens), value)


def is_integer_text(value: Column) -> Column:
    return value.rlike(INTEGER_PATTERN)


def is_number_text(value: Column) -> Column:
    return value.rlike(NUMBER_PATTERN)


def is_boolean_text(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(*TRUE_WORDS, *FALSE_WORDS)


def is_blank(value: Column) -> Column:
    return F.trim(value) == ""


def to_integer(value: Column) -> Column:
    return F.when(is_integer_text(value), F.trim(value).try_cast("bigint"))


def to_number(value: Column) -> Column:
    return F.when(is_number_text(value), F.trim(value).try_cast("double"))


def to_boolean(value: Column) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_date(value: Column) -> Column:
    """A date in any accepted layout. The pattern test keeps bad texts away from the parser."""
    text = F.trim(value)
    tries = [
        F.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(layout)).cast("date"))
        for pattern, layout in DATE_LAYOUTS
    ]
    return F.when(F.length(text) == 10, F.coalesce(*tries))


def to_timestamp(value: Column) -> Column:
    text = F.trim(value)
    reads = text.rlike(TIMESTAMP_PATTERN) | text.rlike(DATE_LAYOUTS[0][0])
    return F.when((F.length(text) >= 10) & reads, text.try_cast("timestamp_ntz"))
