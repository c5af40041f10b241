"""Shared building block: how often each value of each column occurs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import as_text, col, is_numeric, type_name
from plumbline.session import small_table


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column_index, value, n); ``value`` is text, null included as a value.

    All columns share one scan and one shuffle. Each task sums equal values
    before the shuffle, so a value that fills much of the table costs one row
    per task.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("column_index"), as_text(c, types[c]).alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return df.select(F.inline(cells)).groupBy("column_index", "value").agg(F.count("*").alias("n"))


def column_catalog(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (column_index, column_name, dtype, is_numeric) per column of the schema."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = [(i, c, type_name(types[c]), is_numeric(types[c])) for i, c in enumerate(columns)]
    schema = "column_index int, column_name string, dtype string, is_numeric boolean"
    return small_table(df.sparkSession, rows, schema)


def rank_within_column(counts: DataFrame, *order: Column, k: int) -> DataFrame:
    """The first ``k`` rows of each column by ``order``, with their ``rank``.

    Spark keeps ``k`` rows per column in every task before it shuffles, so no
    task ever receives a whole column.
    """
    window = Window.partitionBy("column_index").orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values of one column: (value, count)."""
    return (
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(k)
    )


def with_remainder(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows by ``order`` and, on each, how many rows are not shown."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return (
        df.orderBy(*order)
        .limit(k)
        .withColumn("not_shown", F.greatest(total - F.lit(k), F.lit(0)).cast("bigint"))
    )
