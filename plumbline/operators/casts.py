"""Suggest and apply casts for columns that hold typed values as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import parsing as P
from plumbline.functions.columns import col, string_columns
from plumbline.operators.measures import per_column
from plumbline.session import small_table

# Shares of parseable values from which a type is suggested.
INTEGER_SHARE = 0.90
NUMBER_SHARE = 0.90
DATE_SHARE = 0.80

# Fixed value: the largest integer up to which a double holds every one.
EXACT_INTEGER = 1 << 53

# Names of the cast targets.
INT64, FLOAT64, BOOLEAN, DATE, DATETIME, UTF8, STRING = (
    "Int64",
    "Float64",
    "Boolean",
    "Date",
    "Datetime",
    "Utf8",
    "String",
)

#: Numbers with a zero before another digit.
PADDED = r"^\s*[+-]*0[0-9]"

RATES_SCHEMA = (
    "position int, column_name string, non_null bigint, integers bigint, numbers bigint, booleans bigint, "
    "blanks bigint, dates bigint, timestamps bigint"
)


def cast_rates(df: DataFrame) -> DataFrame:
    """One row per text column: counts of values that read as each type.

    Columns: position, column_name, non_null, integers, numbers, booleans,
    blanks, dates, timestamps. Every value is looked at: a distributed table
    has no "first rows", so shares are over all non-null values.
    """
    return _rates(df).drop("whole", "finite", "padded")


def _rates(df: DataFrame) -> DataFrame:
    """The counts of ``cast_rates``, how many values convert to a 64-bit integer and to a finite number, and how many are padded with zeros."""
    columns = string_columns(df)
    if not columns:
        return small_table(df.sparkSession, [], f"{RATES_SCHEMA}, whole bigint, finite bigint, padded bigint")
    value = F.col("value")
    number = P.to_number(value)
    too_long = F.coalesce(F.abs(P.to_integer(value)) > EXACT_INTEGER, F.lit(True))
    return per_column(
        df,
        columns,
        {c: col(c) for c in columns},
        F.count(value).alias("non_null"),
        F.count_if(P.is_integer_text(value)).alias("integers"),
        F.count_if(P.is_number_text(value)).alias("numbers"),
        F.count_if(P.is_boolean_text(value)).alias("booleans"),
        F.count_if(P.is_blank(value)).alias("blanks"),
        F.count(P.to_date(value)).alias("dates"),
        F.count(P.to_timestamp(value)).alias("timestamps"),
        F.count(P.to_integer(value)).alias("whole"),
        F.count_if((F.abs(number) < F.lit(float("inf"))) & ~(P.is_integer_text(value) & too_long)).alias("finite"),
        F.count_if(value.rlike(PADDED)).alias("padded"),
    )


def _share(part: str):
    return F.col(part) / F.greatest(F.col("non_null"), F.lit(1))


def suggestions(rates: DataFrame) -> DataFrame:
    """The first fitting type of each text column: (position, column_name, suggested_type).

    The order is Int64, Float64, Boolean, Date; columns that fit none, or hold
    only nulls, are absent.
    """
    suggested = (
        F.when(_share("integers") >= INTEGER_SHARE, INT64)
        .when(_share("numbers") >= NUMBER_SHARE, FLOAT64)
        .when((F.col("booleans") > 0) & (F.col("booleans") + F.col("blanks") == F.col("non_null")), BOOLEAN)
        .when(_share("dates") >= DATE_SHARE, DATE)
    )
    return (
        rates.where(F.col("non_null") > 0)
        .select("position", "column_name", suggested.alias("suggested_type"))
        .where(F.col("suggested_type").isNotNull())
    )


def suggest_casts(df: DataFrame) -> dict[str, str]:
    """Cast suggestions as a dict, one entry per column at most, from one pass over ``df``."""
    rows = suggestions(cast_rates(df)).orderBy("position").collect()
    return {r.column_name: r.suggested_type for r in rows}


def infer_casts(df: DataFrame) -> dict[str, str]:
    """Casts that lose no value: every non-null text of the column converts to the type.

    A text that only looks like a number counts for neither kind: integers
    beyond 64 bits and texts like "--5" do not convert, numbers beyond a
    double's range become infinite, and integers beyond 2**53 would be rounded
    in a column of fractions. Numbers padded with zeros, such as 00123, are
    codes that would lose them, so a column with one stays text.
    """
    n = F.col("non_null")
    exact = (
        F.when((F.col("whole") == n) & (F.col("padded") == 0), INT64)
        .when((F.col("finite") == n) & (F.col("padded") == 0), FLOAT64)
        .when((F.col("booleans") == n), BOOLEAN)
        .when(F.col("dates") == n, DATE)
        .when(F.col("timestamps") == n, DATETIME)
    )
    rows = (
        _rates(df)
        .where(n > 0)
        .select("column_name", exact.alias("target"))
        .where(F.col("target").isNotNull())
        .collect()
    )
    return {r.column_name: r.target for r in rows}


_FROM_TEXT = {
    INT64: P.to_integer,
    FLOAT64: P.to_number,
    BOOLEAN: P.to_boolean,
    DATE: P.to_date,
    DATETIME: P.to_timestamp,
}
_SPARK_TYPES = {
    INT64: "bigint",
    FLOAT64: "double",
    BOOLEAN: "boolean",
    DATE: "date",
    DATETIME: "timestamp_ntz",
    UTF8: "string",
    STRING: "string",
}


def apply_casts(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Cast columns; a value that does not convert becomes null.

    Unknown columns and unknown type names are left out. Rows are untouched.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    changed = {}
    for name, target in casts.items():
        if name not in types or target not in _SPARK_TYPES:
            continue
        if isinstance(types[name], T.StringType) and target in _FROM_TEXT:
            changed[name] = _FROM_TEXT[target](col(name))
        else:
            changed[name] = col(name).try_cast(_SPARK_TYPES[target])
    return df.select(*[changed[c].alias(c) if c in changed else col(c) for c in df.columns])
