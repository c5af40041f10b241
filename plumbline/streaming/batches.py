"""Run the table checks on every micro-batch of a stream.

The checks are the ones for tables; a stream only brings the rows in parts.
Each batch writes its own dataset, and a batch that is repeated after a failure
replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.anomalies import Z_THRESHOLD, far_from_mean, value_of, zscore_column
from plumbline.operators.measures import Moments
from plumbline.operators.validate import QualityRules, validate


def write_batches(stream: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write ``make(batch)`` of every micro-batch below ``path``; stops when the present input is used up."""

    def handle(batch: DataFrame, number: int) -> None:
        made = make(batch).withColumn("batch", F.lit(number).cast("bigint"))
        made.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={number}")

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def check_batches(
    stream: DataFrame, path: str, checkpoint: str, rules: QualityRules = QualityRules()
) -> StreamingQuery:
    """Collect the issues of every micro-batch."""
    return write_batches(stream, lambda batch: validate(batch, rules), path, checkpoint)


def flag_batches(
    stream: DataFrame,
    key_cols: Sequence[str],
    moments: dict[str, Moments],
    path: str,
    checkpoint: str,
    threshold: float = Z_THRESHOLD,
) -> StreamingQuery:
    """Flag rows that are far from the stored mean of a table measured before."""

    def flagged(batch: DataFrame) -> DataFrame:
        far = batch.where(far_from_mean(moments, threshold))
        named = far.withColumn("column_name", zscore_column(batch, moments, threshold))
        return named.where(F.col("column_name").isNotNull()).select(
            *key_cols, "column_name", value_of(list(moments), F.col("column_name")).alias("value")
        )

    return write_batches(stream, flagged, path, checkpoint)
