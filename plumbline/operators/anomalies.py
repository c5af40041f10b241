"""Unusual rows: z-scores per column, an isolation forest over all of them, or both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import DetectionError, InsufficientData
from plumbline.functions.columns import as_double, col, numeric_columns, require_columns
from plumbline.operators.forest import SAMPLE_ROWS, TREES, fit_forest, score_column
from plumbline.operators.keys import check_unique, with_file_order, with_row_index
from plumbline.operators.measures import Moments, all_present, measure
from plumbline.operators.quantiles import Extent, exact_quantiles
from plumbline.session import materialize

# Limits of the detection and the labels of its outcome.
MIN_ROWS = 10
MIN_ROWS_FOR_Z = 3
Z_THRESHOLD = 3.0
AUTO_SCORE = -0.5
NO_SCORE = -1.0
BOTH, BY_FOREST, BY_Z = "ensemble", "isolation_forest", "zscore"


@dataclass(frozen=True)
class DetectionSettings:
    contamination: float | str = "auto"
    z_threshold: float = Z_THRESHOLD
    seed: int = 42
    use_forest: bool = True
    use_z: bool = True
    trees: int = TREES
    sample_rows: int = SAMPLE_ROWS
    keys_are_unique: bool = False
    fill_gaps: bool = False


@dataclass(frozen=True)
class Detection:
    """``records`` has one row per flagged row.

    The forest draws ``sample_rows`` rows per tree from the whole table, whatever its size.
    """

    records: DataFrame
    row_count: int


def usable_rows(df: DataFrame, columns: Sequence[str], fill_gaps: bool = False) -> tuple[DataFrame, Column]:
    """The table and the test of the rows that a forest can judge.

    These are the rows that are complete in ``columns``; with ``fill_gaps``
    those with any value there, and gaps count as 0.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    values = {c: as_double(c, types[c]) for c in columns}
    if not fill_gaps:
        return df, all_present(values.values())
    usable = reduce(lambda a, b: a | b, [v.isNotNull() for v in values.values()])
    filled = df.withColumn("__usable", usable).withColumns({c: F.coalesce(values[c], F.lit(0.0)) for c in columns})
    return filled, F.col("__usable")


def can_flag(m: Moments) -> bool:
    """Enough values, and some spread."""
    return m.n >= MIN_ROWS_FOR_Z and bool(m.sd) and isfinite(m.mean) and isfinite(m.sd)


def zscore_column(df: DataFrame, moments: Mapping[str, Moments], threshold: float = Z_THRESHOLD) -> Column:
    """The first column, in the order of ``moments``, whose |z| exceeds the threshold in a row, else null.

    Columns with fewer than 3 values or no spread flag nothing.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    found = [F.lit(None).cast("string")]
    for name, m in moments.items():
        if can_flag(m):
            z = F.abs(as_double(name, types[name]) - F.lit(m.mean)) / F.lit(m.sd)
            found.append(F.when(z > float(threshold), F.lit(name)))
    return F.coalesce(*found)


def far_from_mean(moments: Mapping[str, Moments], threshold: float) -> Column:
    """A plain range test that every z-flagged row passes.

    It compares columns with constants, so file scans can skip whole blocks
    without far values. A little slack leaves the decision to the exact test.
    """
    tests = F.lit(False)
    for name, m in moments.items():
        if can_flag(m):
            reach = threshold * m.sd
            slack = 1e-9 * (abs(m.mean) + reach)
            tests = tests | (col(name) > m.mean + reach - slack) | (col(name) < m.mean - reach + slack)
    return tests


def value_of(columns: Sequence[str], chosen: Column) -> Column:
    """The value, as double, of the column whose name is in ``chosen``."""
    picked = [F.when(chosen == c, col(c).cast("double")) for c in columns]
    return F.coalesce(*picked)


def zscore_records(
    df: DataFrame, key_cols: Sequence[str], columns: Sequence[str] | None = None, threshold: float = Z_THRESHOLD
) -> DataFrame:
    """Rows flagged by z-score: keys, column_name, value, score (-1), method."""
    columns = list(columns or [c for c in numeric_columns(df) if c not in key_cols])
    require_columns(df, [*key_cols, *columns])
    _, _, moments = measure(df, columns)
    flagged = df.where(far_from_mean(moments, threshold)).withColumn(
        "column_name", zscore_column(df, moments, threshold)
    )
    return flagged.where(F.col("column_name").isNotNull()).select(
        *[col(k) for k in key_cols],
        "column_name",
        value_of(columns, F.col("column_name")).alias("value"),
        F.lit(NO_SCORE).alias("score"),
        F.lit(BY_Z).alias("method"),
    )


def zscore_flag(df: DataFrame, columns: Sequence[str], threshold: float = Z_THRESHOLD) -> Column:
    """Whether a row is far from the mean in any of the columns, as a column for any later scan of ``df``."""
    require_columns(df, columns)
    return zscore_column(df, measure(df, columns)[2], threshold).isNotNull()


def empty_records(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    return df.where(F.lit(False)).select(
        *[col(k) for k in key_cols],
        F.lit("").alias("column_name"),
        F.lit(0.0).alias("value"),
        F.lit(0.0).alias("score"),
        F.lit("").alias("method"),
    )


def detect(
    df: DataFrame,
    key_cols: Sequence[str],
    columns: Sequence[str] | None = None,
    settings: DetectionSettings = DetectionSettings(),
) -> Detection:
    """Flag a row if either method does, and say which.

    Records hold the keys, column_name (first column over the z threshold, else
    the first numeric one), its value, the forest score rounded to 4 places (-1
    for rows without one) and the method. The forest scores rows that are
    complete in all ``columns`` (with ``fill_gaps`` those with any value, gaps
    as 0); z-scores look at every value.
    """
    columns = list(columns if columns is not None else [c for c in numeric_columns(df) if c not in key_cols])
    require_columns(df, [*key_cols, *columns])
    if not columns:
        return Detection(empty_records(df, key_cols), 0)
    rows, usable, moments = measure(df, columns)
    if settings.fill_gaps:
        judged, test = usable_rows(df, columns, fill_gaps=True)
        usable = judged.where(test).count()
    for n in (rows, usable):
        if n < MIN_ROWS:
            raise InsufficientData(MIN_ROWS, n)
    if not settings.use_forest and not settings.use_z:
        raise DetectionError("both detection methods are switched off")

    moments = moments if settings.use_z else {}
    narrow = df.select(*[col(c) for c in dict.fromkeys([*key_cols, *columns])])
    narrow, complete = usable_rows(
        narrow.withColumn("__z", zscore_column(df, moments, settings.z_threshold)), columns, settings.fill_gaps
    )
    scored = narrow
    if settings.use_forest:
        if not settings.keys_are_unique:
            check_unique(df, key_cols)
        forest = fit_forest(
            narrow.where(complete), key_cols, columns, usable, 1.0,
            settings.trees, settings.sample_rows, settings.seed,
        )
        scored = scored.withColumn("__score", score_column(narrow, forest, complete))
        if settings.contamination == "auto":
            limit = AUTO_SCORE
        else:
            scored = materialize(scored)
            limit = _score_limit(scored, float(settings.contamination))
        by_forest = F.coalesce(F.col("__score") < limit, F.lit(False))
    else:
        scored = scored.withColumn("__score", F.lit(None).cast("double"))
        by_forest = F.lit(False)

    by_z = F.col("__z").isNotNull()
    named = scored.withColumns(
        {
            "method": F.when(by_forest & by_z, BOTH).when(by_forest, BY_FOREST).when(by_z, BY_Z),
            "column_name": F.coalesce(F.col("__z"), F.lit(columns[0])),
        }
    )
    records = named.where(F.col("method").isNotNull()).select(
        *[col(k) for k in key_cols],
        "column_name",
        value_of(columns, F.col("column_name")).alias("value"),
        F.round(F.coalesce("__score", F.lit(NO_SCORE)), 4).alias("score"),
        "method",
    )
    return Detection(records, rows)


def detect_in_order(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    settings: DetectionSettings = DetectionSettings(),
    name: str = "row_index",
) -> Detection:
    """As ``detect``, with the position of each row as its key, and the records sorted by it.

    Positions are 0-based, in the order of ``order_by``, or, without it, of the
    files that ``df`` is read from. So no key columns are needed and the
    check for unique keys is saved. The sort is by ranges of positions; only records are moved.
    """
    placed = with_file_order(df, name) if order_by is None else with_row_index(df, order_by, name, unique=False)
    chosen = list(columns if columns is not None else numeric_columns(df))
    found = detect(placed, [name], chosen, replace(settings, keys_are_unique=True))
    return Detection(found.records.orderBy(col(name)), found.row_count)


def _score_limit(scored: DataFrame, contamination: float) -> float:
    """The score below which the wanted share of scored rows lies."""
    value = F.col("__score")
    extent = Extent(*scored.agg(F.count(value), F.min(value), F.max(value)).first())
    return exact_quantiles(scored, {"score": value}, {"score": extent}, [contamination])["score"][0]


def anomaly_rate(records: DataFrame, df: DataFrame) -> DataFrame:
    """One row (anomaly_count, row_count, anomaly_rate); the rate is 0 for an empty table."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return records.agg(F.count("*").alias("anomaly_count")).select(
        "anomaly_count",
        total.alias("row_count"),
        F.round(F.coalesce(F.try_divide(F.col("anomaly_count"), total), F.lit(0.0)), 4).alias("anomaly_rate"),
    )
