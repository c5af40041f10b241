"""Data behind charts. Each function returns the rows a renderer would draw."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import PlumblineError
from plumbline.functions.columns import as_double, col, is_numeric, numeric_columns, require_columns, time_columns
from plumbline.operators.correlation import correlation_matrix
from plumbline.operators.counts import top_values
from plumbline.session import materialize

# Chart limits and labels.
HISTOGRAM_BINS = 20
BAR_VALUES = 15
MAX_CHARTS = 4
MAX_POINTS = 1000
GRID_CELLS = 40
ANOMALY, NORMAL = "Anomaly", "Normal"


def flag_rows(df: DataFrame, key_cols: Sequence[str], records: DataFrame | None) -> DataFrame:
    """Add ``is_anomaly``: whether the row's key is among the anomaly records.

    No size is assumed for the records; Spark broadcasts them if they turn out
    to be small.
    """
    if records is None:
        return df.withColumn("is_anomaly", F.lit(False))
    flagged = records.select(*[col(k) for k in key_cols]).distinct().withColumn("__flag", F.lit(True))
    joined = df.join(flagged, list(key_cols), "left")
    return joined.select(*[col(c) for c in df.columns], F.coalesce("__flag", F.lit(False)).alias("is_anomaly"))


def timeseries_data(
    df: DataFrame,
    x: str,
    y: str,
    key_cols: Sequence[str] = (),
    records: DataFrame | None = None,
    bucket: str | None = None,
    flag: Column | None = None,
) -> DataFrame:
    """Points (x, y, is_anomaly); an anomaly without y is not marked.

    ``flag`` marks anomalies in the same scan; without it the rows whose keys
    are among ``records`` are marked, which joins the table with them.

    With ``bucket`` (a unit of ``date_trunc`` such as "day") the normal points
    become one mean per period, so the result is bounded by the time span, and
    every anomaly is kept as it is.
    """
    require_columns(df, [x, y])
    flagged = flag_rows(df, key_cols, records) if flag is None else df.withColumn("is_anomaly", flag)
    marked = flagged.select(
        col(x).alias("x"), col(y).alias("y"), (F.col("is_anomaly") & col(y).isNotNull()).alias("is_anomaly")
    )
    if bucket is None:
        return marked
    line = (
        marked.groupBy(F.date_trunc(bucket, F.col("x").cast("timestamp_ntz")).alias("x"))
        .agg(F.avg("y").alias("y"))
        .withColumn("is_anomaly", F.lit(False))
    )
    points = marked.where("is_anomaly").select(F.col("x").cast("timestamp_ntz").alias("x"), F.col("y").cast("double").alias("y"), "is_anomaly")
    return line.unionByName(points)


def timeseries_bounded(
    df: DataFrame,
    x: str,
    y: str,
    key_cols: Sequence[str] = (),
    records: DataFrame | None = None,
    max_points: int = MAX_POINTS,
    flag: Column | None = None,
) -> DataFrame:
    """Points (x, y, is_anomaly) of a line of bounded length: at most 4 ``max_points`` normal points, and every anomaly.

    The time span of the normal points is cut into ``max_points`` equal
    buckets. Of each bucket's points the first, the last, the lowest and the
    highest stay as they are, so peaks are kept; of equal ones the earliest
    (of equal times the lowest first and the highest last). Points without x or
    y are left out; texts count as times if they read as such. Three scans, and
    only sums by bucket are shuffled.
    """
    require_columns(df, [x, y])
    flagged = flag_rows(df, key_cols, records) if flag is None else df.withColumn("is_anomaly", flag)
    time = col(x).try_cast("timestamp_ntz")
    points = flagged.select(time.alias("x"), as_double(y, df.schema[y].dataType).alias("y"), "is_anomaly").where("x IS NOT NULL AND y IS NOT NULL")
    micros = F.unix_micros(F.col("x").cast("timestamp"))
    normal = points.where(~F.col("is_anomaly"))
    low, high = normal.agg(F.min(micros), F.max(micros)).first()
    if low is None:
        return points
    width = (high - low) // max_points + 1
    placed = normal.select("x", "y", F.floor((micros - F.lit(low)) / F.lit(width)).alias("bucket"))
    ends = placed.groupBy("bucket").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.min("y").alias("low"), F.max("y").alias("high"))
    at = F.col("x"), F.col("y")
    picked = (
        placed.join(F.broadcast(ends), "bucket")  # ``max_points`` rows at most
        .groupBy("bucket")
        .agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("first", "last", "low", "high")],
            F.min(F.when(at[0] == F.col("first"), at[1])).alias("first_y"),
            F.max(F.when(at[0] == F.col("last"), at[1])).alias("last_y"),
            F.min(F.when(at[1] == F.col("low"), at[0])).alias("low_x"),
            F.min(F.when(at[1] == F.col("high"), at[0])).alias("high_x"),
        )
    )
    ways = (("first", "first_y"), ("last", "last_y"), ("low_x", "low"), ("high_x", "high"))
    corners = F.array_distinct(F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in ways]))
    line = picked.select(F.inline(corners)).withColumn("is_anomaly", F.lit(False))
    return line.unionByName(points.where("is_anomaly"))


def scatter_grid(
    df: DataFrame,
    x: str,
    y: str,
    key_cols: Sequence[str] = (),
    records: DataFrame | None = None,
    cells: int = GRID_CELLS,
    flag: Column | None = None,
) -> DataFrame:
    """(x, y, n, status) of bounded size: how many normal points each cell of a grid holds, at its middle, and every anomaly.

    The grid has ``cells`` by ``cells`` cells between the least and the
    greatest finite values of the normal points. Points that are not finite
    stay out of it. An anomaly is a point of its own, with n 1.
    """
    require_columns(df, [x, y])
    flagged = flag_rows(df, key_cols, records) if flag is None else df.withColumn("is_anomaly", flag)
    values = [as_double(c, df.schema[c].dataType).alias(n) for c, n in ((x, "x"), (y, "y"))]
    points = flagged.select(*values, "is_anomaly").where("x IS NOT NULL AND y IS NOT NULL")
    finite = reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in ("x", "y")])
    normal = points.where(~F.col("is_anomaly") & finite)
    least_x, most_x, least_y, most_y = normal.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    anomalies = points.where("is_anomaly").select("x", "y", F.lit(1).cast("bigint").alias("n"), F.lit(ANOMALY).alias("status"))
    if least_x is None:
        return anomalies
    places, middles = [], []
    for name, low, high in (("x", least_x, most_x), ("y", least_y, most_y)):
        width = high / cells - low / cells
        place = F.least(F.floor((F.col(name) - F.lit(low)) / F.lit(width)), F.lit(cells - 1)) if width > 0 else F.lit(0)
        places.append(place.cast("int").alias(f"at_{name}"))
        middles.append((F.lit(low) + (F.col(f"at_{name}") + (0.5 if width > 0 else 0.0)) * F.lit(width)).alias(name))
    counted = normal.select(*places).groupBy("at_x", "at_y").agg(F.count("*").alias("n"))
    return counted.select(*middles, "n", F.lit(NORMAL).alias("status")).unionByName(anomalies)


def histogram_data(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Non-empty bins of equal width: (bin, bin_start, bin_end, count); one bin if all values are equal.

    Infinite values have no bin of a width; they come as bins of their own, -1
    and ``bins``, without another end.
    """
    require_columns(df, [column])
    dtype = df.schema[column].dataType
    if not is_numeric(dtype):
        raise PlumblineError(f"column '{column}' is not numeric ({dtype.simpleString()})")
    value = as_double(column, dtype)
    finite = F.abs(value) < F.lit(float("inf"))
    low, high = df.agg(F.min(F.when(finite, value)), F.max(F.when(finite, value))).first()
    width = (high - low) / bins if low is not None and high > low else 0.0
    place: Column = F.lit(0)
    if width > 0:
        place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    infinite = F.lit(float("inf"))
    place = F.when(F.col("v") == infinite, bins).when(F.col("v") == -infinite, -1).otherwise(place)
    return (
        df.select(value.alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy(place.cast("int").alias("bin"))
        .agg(F.count("*").alias("count"))
        .select(
            "bin",
            F.when(F.col("bin") == bins, infinite).when(F.col("bin") >= 0, F.lit(low).cast("double") + F.col("bin") * F.lit(width)).alias("bin_start"),
            F.when(F.col("bin") == -1, -infinite).when(F.col("bin") < bins, F.lit(low).cast("double") + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
            "count",
        )
    )


def bar_data(df: DataFrame, column: str, top_n: int = BAR_VALUES) -> DataFrame:
    """The most frequent non-null values: (value, count); equal counts are ordered by value."""
    require_columns(df, [column])
    return top_values(df, column, top_n)


def heatmap_data(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return correlation_matrix(df, columns)


def scatter_data(
    df: DataFrame,
    x: str,
    y: str,
    key_cols: Sequence[str] = (),
    records: DataFrame | None = None,
    normal_share: float | None = None,
    seed: int = 42,
    flag: Column | None = None,
) -> DataFrame:
    """Points (x, y, status) where both values are present; ``flag`` as in ``timeseries_data``.

    With ``normal_share`` all anomalies stay and normal rows are drawn by a
    hash of their key, which gives the same points for any partitioning.
    """
    require_columns(df, [x, y])
    there = df.where(col(x).isNotNull() & col(y).isNotNull())
    marked = flag_rows(there, key_cols, records) if flag is None else there.withColumn("is_anomaly", flag)
    if normal_share is not None:
        key = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key_cols or df.columns])
        draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % 1_000_000
        marked = marked.where(F.col("is_anomaly") | (draw < int(normal_share * 1_000_000)))
    return marked.select(
        col(x).alias("x"), col(y).alias("y"), F.when(F.col("is_anomaly"), ANOMALY).otherwise(NORMAL).alias("status")
    )


def auto_charts(
    df: DataFrame,
    key_cols: Sequence[str] = (),
    records: DataFrame | None = None,
    max_charts: int = MAX_CHARTS,
    bucket: str | None = None,
    normal_share: float | None = None,
    heatmap_columns: Sequence[str] | None = None,
    max_points: int | None = None,
) -> dict[str, DataFrame]:
    """The most telling charts of a table, by name: timeseries, scatter, histogram, heatmap.

    The histogram shows the column of the first anomaly record (in key order),
    or the first numeric column. The heat map shows all numeric columns unless
    ``heatmap_columns`` names some. With ``max_points`` the time series and the
    scatter plot are of bounded size, as ``timeseries_bounded`` and
    ``scatter_grid`` give them. The records are joined with the table once;
    the charts read a copy of the columns they show.
    """
    numeric = [c for c in numeric_columns(df) if c not in key_cols] or numeric_columns(df)
    times = time_columns(df)
    charts: dict[str, DataFrame] = {}
    shown, flag = df, F.lit(False)
    if records is not None and numeric and (times or len(numeric) >= 2):
        narrow = df.select(*[col(c) for c in dict.fromkeys([*key_cols, *times[:1], *numeric[:2]])])
        marked = flag_rows(narrow, key_cols, records).withColumnRenamed("is_anomaly", "__is_anomaly")
        shown, flag = materialize(marked), F.col("__is_anomaly")
    if times and numeric:
        if max_points is None:
            charts["timeseries"] = timeseries_data(shown, times[0], numeric[0], key_cols, bucket=bucket, flag=flag)
        else:
            charts["timeseries"] = timeseries_bounded(shown, times[0], numeric[0], max_points=max_points, flag=flag)
    if len(numeric) >= 2 and len(charts) < max_charts:
        if max_points is None:
            charts["scatter"] = scatter_data(shown, numeric[0], numeric[1], key_cols, normal_share=normal_share, flag=flag)
        else:
            charts["scatter"] = scatter_grid(shown, numeric[0], numeric[1], cells=max(1, int(max_points**0.5)), flag=flag)
    if numeric and len(charts) < max_charts:
        charts["histogram"] = histogram_data(df, _first_flagged(key_cols, records, numeric))
    if len(numeric) >= 2 and len(charts) < max_charts:
        charts["heatmap"] = heatmap_data(df, heatmap_columns or numeric)
    return charts


def _first_flagged(key_cols: Sequence[str], records: DataFrame | None, numeric: Sequence[str]) -> str:
    if records is None:
        return numeric[0]
    first = (
        records.where(F.col("column_name").isin(list(numeric)))
        .orderBy(*[col(k) for k in key_cols])
        .select("column_name")
        .first()
    )
    return first["column_name"] if first else numeric[0]
