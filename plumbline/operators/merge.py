"""Put several loaded tables together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import PlumblineError
from plumbline.functions.columns import as_text, col, is_numeric, is_time
from plumbline.operators.keys import with_file_order, with_row_index


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same set of columns, matched by name.

    Numbers of different width, and dates with timestamps, widen. Other columns
    whose types differ become text, so that no value is lost or refused.
    """
    for name in frames[0].columns:
        types = [f.schema[name].dataType for f in frames]
        if len(set(types)) > 1 and not (all(map(is_numeric, types)) or all(map(is_time, types))):
            frames = [f.withColumn(name, as_text(name, f.schema[name].dataType)) for f in frames]
    return reduce(lambda a, b: a.unionByName(b), frames)


def side_by_side(
    frames: Sequence[DataFrame], orders: Sequence[Sequence[str] | None] | None = None, unique: bool = True
) -> DataFrame:
    """Row i of every table on one line; shorter tables are padded with nulls.

    ``orders`` gives each table the columns that fix its row order; a table
    without (None) has its rows in the order of its files. A column name that
    already exists gets the number of its table as a suffix.
    """
    orders = [None] * len(frames) if orders is None else orders
    if len(orders) != len(frames):
        raise PlumblineError("side-by-side merging needs the order columns of every table")
    taken: set[str] = set()
    merged = None
    for number, (frame, order) in enumerate(zip(frames, orders)):
        indexed = with_file_order(frame, "__row") if order is None else with_row_index(frame, order, "__row", unique)
        renamed = []
        for name in frame.columns:
            new = name if name not in taken else f"{name}_{number}"
            if new in taken:
                raise PlumblineError(f"cannot find a free name for column {name}")
            taken.add(new)
            renamed.append(col(name).alias(new))
        indexed = indexed.select("__row", *renamed)
        merged = indexed if merged is None else merged.join(indexed, "__row", "full")
    return merged.withColumnRenamed("__row", "row_index")


def merge(
    frames: Sequence[DataFrame],
    orders: Sequence[Sequence[str] | None] | None = None,
    spark: SparkSession | None = None,
    unique: bool = True,
) -> DataFrame:
    """Stack tables with equal column sets; put others side by side, in the row orders given by ``orders``.

    Without ``orders`` the rows of files stand in the order of the files. Other
    tables have none, so with other columns they raise, as do all that cannot
    be merged. No tables give an empty one.
    """
    if not frames:
        session = spark or SparkSession.active()
        return session.createDataFrame([], "struct<>")
    if len(frames) == 1:
        return frames[0]
    if len({frozenset(f.columns) for f in frames}) == 1:
        return stack(frames)
    return side_by_side(frames, orders, unique).drop("row_index")


def check_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of ``child.column`` that ``parent.key`` lacks: (value, affected_rows).

    The child is counted per value first, so a value shared by much of the
    table meets the join as one row. Null references nothing.
    """
    used = (
        child.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("affected_rows"))
    )
    known = parent.select(col(key).alias("value"))
    return used.join(known, "value", "left_anti")


def check_list_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """As ``check_references`` for a column that holds arrays of references."""
    return check_references(child.select(F.explode(col(column)).alias("item")), "item", parent, key)
