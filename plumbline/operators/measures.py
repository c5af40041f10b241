"""Aggregates over many columns in one scan, however many there are."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double
from plumbline.session import small_table


def per_column(df: DataFrame, columns: Sequence[str], values: Mapping[str, Column], *measures: Column) -> DataFrame:
    """One row (position, column_name, measures) per column; the measures are aggregates of ``value``.

    Every row is turned into one short row per column inside its task and
    summed there by position, so that the table is read once, the aggregate
    stays as narrow (and compiled) for a thousand columns as for one, and one
    row per column and task is shuffled. ``values`` gives each column's value,
    all of one type. One null cell per column is added, which no aggregate of
    ``value`` counts, so that an empty table has its rows, too.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("position"), values[c].alias("value")) for i, c in enumerate(columns)])
    names = small_table(df.sparkSession, list(enumerate(columns)), "position int, column_name string")
    rows = df.select(F.inline(cells))
    empty = names.select("position", F.lit(None).cast(rows.schema["value"].dataType).alias("value"))
    measured = rows.unionAll(empty).groupBy("position").agg(*measures)
    return names.join(measured, "position").select("position", "column_name", *measured.columns[1:])


@dataclass(frozen=True)
class Moments:
    """Count, mean and population deviation of one column."""

    n: int
    mean: float | None
    sd: float | None


def all_present(values: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, [v.isNotNull() for v in values])


def measure(df: DataFrame, columns: Sequence[str]) -> tuple[int, int, dict[str, Moments]]:
    """Rows, rows that are complete in ``columns``, and the moments of each column, in one scan. NaN counts as missing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    values = {c: as_double(c, types[c]) for c in columns}
    complete = all_present(values.values())
    # The last cell of a row is not a column: it counts the rows and says whether this one is complete.
    cells = [F.struct(F.lit(i).alias("position"), v.alias("value")) for i, v in enumerate(values.values())]
    cells.append(F.struct(F.lit(len(cells)).alias("position"), F.when(complete, 1.0).alias("value")))
    value = F.col("value")
    found = (
        df.select(F.inline(F.array(*cells)))
        .groupBy("position")
        .agg(F.count("*").alias("n"), F.count(value).alias("present"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
        .collect()
    )
    by_position = {r.position: r for r in found}
    last = by_position.get(len(columns))
    moments = {c: Moments(r.present, r.mean, r.sd) if (r := by_position.get(i)) else Moments(0, None, None) for i, c in enumerate(columns)}
    return (last.n, last.present, moments) if last else (0, 0, moments)
