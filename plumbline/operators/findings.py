"""Plain sentences about a table, derived from its statistics and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col

# Which columns count as mostly null, and how many of them are named.
NULL_SHARE = 0.3
NAMED_COLUMNS = 3


def findings(stats: DataFrame, records: DataFrame, key_cols: Sequence[str], named_columns: int | None = NAMED_COLUMNS) -> DataFrame:
    """Rows (finding_order, finding): size, anomaly share, first anomaly, columns with many nulls.

    ``stats`` comes from ``compute_stats``, ``records`` from the anomaly
    operators. The first anomaly is the one with the smallest key. The sentence
    about nulls names ``named_columns`` columns (None: all).
    """
    count, nulls = F.col("count"), F.col("null_count")
    sizes = stats.agg(
        F.count("*").alias("columns"),
        F.coalesce(F.max(count + nulls), F.lit(0)).alias("rows"),
        F.array_sort(
            F.collect_list(F.when((count > 0) & (nulls / (count + nulls) > NULL_SHARE), F.struct("position", "column_name")))
        ).alias("sparse"),
    )
    keys = [col(k) for k in key_cols]
    label = F.concat_ws(", ", *[k.cast("string") for k in keys])
    flagged = records.agg(
        F.count("*").alias("anomalies"),
        F.min_by(
            F.struct(label.alias("row"), F.col("column_name"), F.col("value"), F.col("score")), F.struct(*keys)
        ).alias("first"),
    )
    # Both results are one row each; the second one joins the first as a scalar.
    facts = sizes.withColumn("a", flagged.select(F.struct("anomalies", "first")).scalar())
    rows, found, first = F.col("rows"), F.col("a.anomalies"), F.col("a.first")
    named = F.transform(F.slice("sparse", 1, named_columns) if named_columns else F.col("sparse"), lambda e: e["column_name"])

    # The sentence formats.
    sentences = [
        F.format_string("Dataset contains %,d rows across %d columns.", rows, F.col("columns")),
        F.when(
            found > 0,
            F.format_string(
                "%d anomalies detected (%.1f%% of rows).", found, found * F.lit(100.0) / F.greatest(rows, F.lit(1))
            ),
        ).otherwise("No anomalies detected in the dataset."),
        F.when(
            found > 0,
            F.format_string(
                "Most significant anomaly at row %s: %s = %s (score=%.3f).",
                first["row"],
                first["column_name"],
                first["value"].cast("string"),
                first["score"],
            ),
        ),
        F.when(
            F.size("sparse") > 0,
            F.format_string("Columns with >30%% null values: %s.", F.array_join(named, ", ")),
        ),
    ]
    return facts.select(F.posexplode(F.array(*sentences)).alias("finding_order", "finding")).where(
        F.col("finding").isNotNull()
    )
