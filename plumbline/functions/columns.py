"""Schema helpers: pick columns by type and render values as text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import MissingColumns

# Name fragments that mark a text column as a time axis.
TIME_NAME_PARTS = ("date", "time", "ts", "timestamp", "created", "updated")

# Type names accepted in expectations, with the Spark type each one stands for.
TYPE_ALIASES = {
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "float32": "float",
    "float64": "double",
    "utf8": "string",
    "string": "string",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp_ntz",
}


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise MissingColumns(f"columns not in the frame: {absent}")


def is_numeric(dtype: T.DataType) -> bool:
    """Integers, floats and decimals. Boolean is not numeric."""
    return isinstance(dtype, T.NumericType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    """Date and timestamp columns, and text columns whose name contains a time word."""
    found = []
    for field in df.schema.fields:
        if is_time(field.dataType):
            found.append(field.name)
        elif isinstance(field.dataType, T.StringType):
            lowered = field.name.lower()
            if any(part in lowered for part in TIME_NAME_PARTS):
                found.append(field.name)
    return found


def type_name(dtype: T.DataType) -> str:
    return dtype.simpleString()


def canonical_type(name: str) -> str:
    """Spark's name of a type given by Spark name or by alias, in any letter case."""
    lowered = name.strip().lower()
    return TYPE_ALIASES.get(lowered, lowered)


def as_double(name: str, dtype: T.DataType) -> Column:
    """The column as double with NaN turned into null, so that aggregates skip it."""
    value = col(name).cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def as_text(name: str, dtype: T.DataType) -> Column:
    """A text form that is equal exactly when the values are equal; null stays null."""
    value = col(name)
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0).cast(dtype)).cast("string")  # -0.0 becomes 0.0
    if isinstance(dtype, T.BinaryType):
        return F.base64(value)
    if isinstance(dtype, T.MapType):
        return F.when(value.isNotNull(), F.to_json(F.array_sort(F.map_entries(value))))
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))
    return value.cast("string")


def groupable(name: str, dtype: T.DataType) -> Column:
    """The column itself, or its text form for types that Spark cannot group by."""
    if isinstance(dtype, T.MapType):
        return as_text(name, dtype)
    return col(name)
