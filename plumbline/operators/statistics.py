"""Descriptive statistics of numeric and categorical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double, as_text, col, numeric_columns, require_columns, type_name
from plumbline.operators.counts import column_catalog, rank_within_column, value_counts
from plumbline.operators.heavy import frequent_texts
from plumbline.operators.measures import per_column
from plumbline.operators.quantiles import BUCKETS, Extent, exact_quantiles
from plumbline.session import small_table

# The reported quantiles and the number of most frequent values.
QUARTILES = (0.25, 0.50, 0.75)
TOP_VALUES = 5

NUMERIC_SCHEMA = (
    "position int, column_name string, dtype string, count bigint, null_count bigint, mean double, "
    "std double, min double, max double, p25 double, p50 double, p75 double"
)
CATEGORICAL_SCHEMA = "position int, column_name string, dtype string, count bigint, null_count bigint, top_values array<string>"
STATS_SCHEMA = NUMERIC_SCHEMA + ", top_values array<string>"


def numeric_stats(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    quantiles: str = "exact",
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per numeric column: count, null_count, mean, std, min, max, p25, p50, p75.

    The standard deviation is the sample one, 0 for a single value. Quantiles
    interpolate linearly. One fused pass measures the columns; from its counts
    and extremes ``exact_quantiles`` finds the quantiles. ``quantiles="approx"``
    sketches them in the same pass instead.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    require_columns(df, columns)
    spark = df.sparkSession
    if not columns:
        return small_table(spark, [], NUMERIC_SCHEMA)
    types = {f.name: f.dataType for f in df.schema.fields}
    values = {c: as_double(c, types[c]) for c in columns}

    cells = {c: F.struct(col(c).isNotNull().alias("there"), v.alias("v")) for c, v in values.items()}
    v = F.col("value.v")
    measures = [
        F.count_if("value.there").alias("count"),
        F.count_if(~F.col("value.there")).alias("null_count"),
        F.count(v).alias("usable"),
        F.avg(v).alias("mean"),
        F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]
    if quantiles == "approx":
        measures.append(F.percentile_approx(v, list(QUARTILES), F.lit(10_000)).alias("points"))
    measured = {r["column_name"]: r for r in per_column(df, columns, cells, *measures).collect()}
    if quantiles == "approx":
        points = {c: measured[c]["points"] or [None] * len(QUARTILES) for c in columns}
    else:
        extents = {c: Extent(measured[c]["usable"], measured[c]["min"], measured[c]["max"]) for c in columns}
        points = exact_quantiles(df, values, extents, QUARTILES, buckets)
    fields = ("count", "null_count", "mean", "std", "min", "max")
    rows = [
        (i, c, type_name(types[c]), *[measured[c][f] for f in fields], *points[c]) for i, c in enumerate(columns)
    ]
    return small_table(spark, rows, NUMERIC_SCHEMA)


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """One row per non-numeric column: count, null_count and the ``k`` most frequent values.

    Equal counts are ordered by value. Columns whose first values bounded
    summaries can prove (see ``frequent_texts``) are settled by one scan or two
    when this is called; only the values of others are all counted. An empty
    table gives no rows.
    """
    numeric = set(numeric_columns(df))
    columns = list(columns if columns is not None else [c for c in df.columns if c not in numeric])
    if not columns:
        return small_table(df.sparkSession, [], CATEGORICAL_SCHEMA)
    require_columns(df, columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    found = frequent_texts(df, [as_text(c, types[c]) for c in columns], k)
    rows = [
        (i, c, type_name(types[c]), one.rows - one.nulls, one.nulls, [v for v, _ in one.first])
        for i, (c, one) in enumerate(zip(columns, found))
        if one.first is not None and one.rows
    ]
    settled = small_table(df.sparkSession, rows, CATEGORICAL_SCHEMA)
    rest = [c for c, one in zip(columns, found) if one.first is None]
    if not rest:
        return settled
    counted = _counted_categories(df, rest, k)
    place: Column = F.lit(None).cast("int")
    for i, name in enumerate(columns):
        place = F.when(F.col("column_name") == name, i).otherwise(place)
    return settled.unionByName(counted.withColumn("position", place))


def _counted_categories(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The same with every value counted."""
    counts = value_counts(df, columns)
    value, n = F.col("value"), F.col("n")
    totals = counts.groupBy("column_index").agg(
        F.sum(F.when(value.isNotNull(), n).otherwise(0)).alias("count"),
        F.sum(F.when(value.isNull(), n).otherwise(0)).alias("null_count"),
    )
    # Nulls rank last instead of being filtered, so that both branches read the same shuffle.
    ranked = rank_within_column(counts, value.isNull(), F.desc("n"), value, k=k)
    top = ranked.where(value.isNotNull()).groupBy("column_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda e: e["value"]).alias("top_values")
    )
    return (
        column_catalog(df, columns)
        .join(totals, "column_index")
        .join(top, "column_index", "left")
        .select(
            F.col("column_index").alias("position"),
            "column_name",
            "dtype",
            F.col("count").cast("bigint").alias("count"),
            F.col("null_count").cast("bigint").alias("null_count"),
            F.coalesce("top_values", F.array().cast("array<string>")).alias("top_values"),
        )
    )


def compute_stats(df: DataFrame, quantiles: str = "exact") -> DataFrame:
    """Statistics of every column, in column order; no rows for an empty table."""
    order = {c: i for i, c in enumerate(df.columns)}
    numeric = numeric_columns(df)
    other = [c for c in df.columns if c not in set(numeric)]
    empty = F.array().cast("array<string>")
    parts = []
    if numeric:
        stats = numeric_stats(df, numeric, quantiles).withColumn("top_values", empty)
        parts.append(stats.where(F.col("count") + F.col("null_count") > 0))
    if other:
        stats = categorical_stats(df, other)
        measures = ("mean", "std", "min", "max", "p25", "p50", "p75")
        parts.append(stats.withColumns({m: F.lit(None).cast("double") for m in measures}))
    if not parts:
        return small_table(df.sparkSession, [], STATS_SCHEMA)
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    place: Column = F.lit(None).cast("int")
    for name, i in order.items():
        place = F.when(F.col("column_name") == name, i).otherwise(place)
    return both.withColumn("position", place)
