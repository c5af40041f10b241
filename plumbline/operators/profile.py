"""Schema profile: nulls, distinct values and samples of every column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import PlumblineError
from plumbline.functions import parsing as P
from plumbline.functions.columns import as_text, col, numeric_columns, string_columns
from plumbline.operators.counts import column_catalog, rank_within_column, value_counts
from plumbline.operators.sketches import ColumnState, collect_states, merge_states
from plumbline.operators.states import merged_states
from plumbline.session import small_table

# Limits of the profile and of the issues drawn from it.
SAMPLE_VALUES = 5
HIGH_NULL_RATE = 0.50
NUMERIC_TEXT_SHARE = 0.90
ID_SHARE = 0.95
ID_MIN_ROWS = 10


def profile(df: DataFrame, distinct: str = "exact", samples: int = SAMPLE_VALUES) -> DataFrame:
    """One row per column.

    Columns: position, column_name, dtype, nullable (nulls were seen),
    row_count, null_count, null_rate (4 places), unique_count (null counts as a
    value), is_approx, number_share (share of a text column's values that read
    as numbers), samples (up to ``samples`` distinct values, smallest first).

    ``distinct`` is "exact" (one shuffle of the distinct values), "approx" (one
    scan when it is called, in which every task keeps a sketch and a few values
    per column) or "approx-text" (that for text columns only). The choice is
    the caller's, whatever the size of the table.
    """
    names = df.columns
    choices = {"exact": [], "approx": list(names), "approx-text": string_columns(df)}
    if distinct not in choices:
        raise PlumblineError(f"distinct must be one of {list(choices)}")
    rough = choices[distinct]
    exact = [c for c in names if c not in rough]
    catalog = column_catalog(df, names)
    parts = []
    if exact:
        parts.append(_exact_profile(df, exact, samples))
    if rough:
        parts.append(_sketched_profile(df, rough, samples))
    measured = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows, nulls = F.coalesce("row_count", F.lit(0)), F.coalesce("null_count", F.lit(0))
    no_samples = F.array().cast("array<string>")
    return catalog.join(measured, "column_name", "left").select(
        F.col("column_index").alias("position"),
        "column_name",
        "dtype",
        (nulls > 0).alias("nullable"),
        rows.cast("bigint").alias("row_count"),
        nulls.cast("bigint").alias("null_count"),
        F.round(F.coalesce(F.try_divide(nulls, rows), F.lit(0.0)), 4).alias("null_rate"),
        F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"),
        F.coalesce("is_approx", F.lit(False)).alias("is_approx"),
        "number_share",
        F.coalesce("samples", no_samples).alias("samples"),
    )


def _exact_profile(df: DataFrame, columns: list[str], samples: int) -> DataFrame:
    counts = value_counts(df, columns)
    named = column_catalog(df, columns)
    value, n = F.col("value"), F.col("n")
    text_indexes = [i for i, c in enumerate(columns) if c in set(string_columns(df))]
    is_text = F.col("column_index").isin(text_indexes) if text_indexes else F.lit(False)
    present = F.sum(F.when(value.isNotNull(), n))
    measured = counts.groupBy("column_index").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(value.isNull(), n).otherwise(0)).alias("null_count"),
        F.count("*").alias("unique_count"),
        F.try_divide(F.sum(F.when(is_text & P.is_number_text(value), n).otherwise(0)), present).alias("number_share"),
    )
    result = named.join(measured, "column_index")
    if samples:
        numeric = set(numeric_columns(df)) & set(columns)
        other = [i for i, c in enumerate(columns) if c not in numeric] or [-1]
        # Nulls rank last instead of being filtered, so that both branches read the same shuffle.
        as_number = F.when(~F.col("column_index").isin(other), value.try_cast("double")) if numeric else F.lit(0)
        ranked = rank_within_column(counts, value.isNull(), as_number, value, n, k=samples)
        listed = ranked.where(value.isNotNull()).groupBy("column_index").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda e: e["value"]
            ).alias("samples")
        )
        result = result.join(listed, "column_index", "left")
    else:
        result = result.withColumn("samples", F.lit(None).cast("array<string>"))
    return result.select(
        "column_name",
        "row_count",
        "null_count",
        "unique_count",
        F.lit(False).alias("is_approx"),
        F.when(F.col("dtype") == "string", F.col("number_share")).alias("number_share"),
        "samples",
    )


def _sketched_profile(df: DataFrame, columns: list[str], samples: int) -> DataFrame:
    """One scan: every task keeps one bounded state per column, and these are merged."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = set(numeric_columns(df))
    texts = frozenset(i for i, c in enumerate(columns) if c in set(string_columns(df)))
    inputs = []
    for i, name in enumerate(columns):
        value = col(name) if name in numeric else as_text(name, types[name])
        if isinstance(types[name], (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0).cast(types[name])  # -0.0 becomes 0.0
        inputs.append((value if samples else F.when(value.isNotNull(), True)).alias(f"v{i}"))
        inputs.append(F.xxhash64(value).alias(f"h{i}"))
        if i in texts:
            inputs.append(P.is_number_text(value).alias(f"n{i}"))
    found = merged_states(df.select(*inputs), collect_states(len(columns), texts, samples), merge_states)
    states = [ColumnState.unpack(found[i]) if i in found else ColumnState(samples) for i in range(len(columns))]
    shown = _as_shown(df.sparkSession, [s.smallest for s in states], [types[c] if c in numeric else T.StringType() for c in columns])
    rows = []
    for i, (name, s) in enumerate(zip(columns, states)):
        present = s.rows - s.nulls
        share = s.numbers / present if i in texts and present else None
        rows.append((name, s.rows, s.nulls, round(s.registers.estimate()) + (s.nulls > 0), True, share, shown[i]))
    schema = (
        "column_name string, row_count bigint, null_count bigint, unique_count bigint, is_approx boolean, "
        "number_share double, samples array<string>"
    )
    return small_table(df.sparkSession, rows, schema)


def _as_shown(spark: SparkSession, values: list[list], types: list[T.DataType]) -> list[list[str]]:
    """A few values of each column in the text form of Spark."""
    schema = T.StructType([T.StructField(f"s{i}", T.ArrayType(kind)) for i, kind in enumerate(types)])
    frame = spark.createDataFrame([tuple(values)], schema)
    return list(frame.select(*[F.transform(f"s{i}", lambda x: x.cast("string")).alias(f"s{i}") for i in range(len(types))]).first())


def profile_issues(profiled: DataFrame) -> DataFrame:
    """Issues visible in a profile: (position, column_name, severity, message, affected_rows).

    The likely-ID warning needs an exact distinct count.
    """
    name, dtype = F.col("column_name"), F.col("dtype")
    rows, nulls = F.col("row_count"), F.col("null_count")
    null_share = F.try_divide(nulls, rows)
    unique_share = F.try_divide(F.col("unique_count"), rows)
    text = dtype == "string"

    def issue(when, severity, message, affected):
        return F.when(
            when,
            F.struct(
                F.lit(severity).alias("severity"),
                message.alias("message"),
                affected.cast("bigint").alias("affected_rows"),
            ),
        )

    # The message formats.
    found = F.array(
        issue(
            null_share > HIGH_NULL_RATE,
            "warning",
            F.format_string("%.0f%% null values (%d/%d rows)", null_share * 100, nulls, rows),
            nulls,
        ),
        issue(
            text & (F.col("number_share") >= NUMERIC_TEXT_SHARE),
            "warning",
            F.format_string("Column '%s' is String but values appear numeric — consider casting", name),
            F.lit(0),
        ),
        issue(
            text & ~F.col("is_approx") & (rows > ID_MIN_ROWS) & (unique_share > ID_SHARE),
            "warning",
            F.format_string(
                "High-cardinality column (%.0f%% unique) — likely an ID, may not be useful for analysis",
                unique_share * 100,
            ),
            F.lit(0),
        ),
        issue(
            (rows > 0) & (nulls == rows),
            "error",
            F.format_string("Column '%s' is entirely null", name),
            rows,
        ),
    )
    return profiled.select(
        "position", "column_name", F.inline(F.array_compact(found))
    )
