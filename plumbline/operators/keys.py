"""Row identity: unique keys and contiguous row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.errors import DuplicateKeys, PlumblineError
from plumbline.functions.columns import col, groupable, require_columns
from plumbline.session import materialize, small_table

_POSITION_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the place within a partition here


def check_unique(df: DataFrame, key_cols: Sequence[str]) -> None:
    """Raise unless the key columns identify every row.

    Eight bytes of hash per row are counted; only rows whose hash repeats are
    compared key by key.
    """
    require_columns(df, key_cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = df.select(*[groupable(k, types[k]).alias(f"k{i}") for i, k in enumerate(key_cols)])
    names = keys.columns
    hashed = keys.withColumn("__hash", F.xxhash64(*names))
    again = hashed.groupBy("__hash").agg(F.count("*").alias("n")).where("n > 1").select("__hash")
    if again.isEmpty():
        return
    twice = hashed.join(again, "__hash", "left_semi").groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise DuplicateKeys(f"columns {list(key_cols)} do not identify rows")


def with_row_index(
    df: DataFrame, order_by: Sequence[str], name: str = "row_index", unique: bool = True
) -> DataFrame:
    """Add 0-based positions in the order of ``order_by``, without gaps.

    Rows are range-partitioned and sorted, written once with their place inside
    the partition, and shifted by the number of rows in earlier partitions; no
    task sees more than its range. With ``unique=False`` ties are allowed: the
    input is written first, so that its arrival order is fixed and can part
    equal rows into several ranges.
    """
    require_columns(df, order_by)
    order = [col(c) for c in order_by]
    if not unique:
        df = materialize(df).withColumn("__arrival", F.monotonically_increasing_id())
        order.append(F.col("__arrival"))
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns(
            {
                "__part": F.spark_partition_id(),
                "__place": F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)),
            }
        )
        .drop("__arrival")
    )
    stored = materialize(placed)
    sizes = stored.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()
    starts, total = [], 0
    for row in sizes:  # one row per partition
        starts.append((row["__part"], total))
        total += row["n"]
    begins = small_table(df.sparkSession, starts, "__part int, __begin bigint")
    placed = stored.join(F.broadcast(begins), "__part")
    return placed.withColumn(name, F.col("__begin") + F.col("__place")).drop("__part", "__place", "__begin")


def with_file_order(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Add 0-based positions in the order of the files ``df`` is read from: by path, then by place in the file.

    ``df`` may have been projected and filtered since it was read, but not
    joined or grouped. Tasks read the rows of a block of a file in their order;
    so one pass writes every row with its file, its block and its place, and a
    small table of what each block's rows begin with turns these into positions.
    Files are ordered by the text of their path.
    """
    if name in df.columns:
        raise PlumblineError(f"column {name} is there already")
    block = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    try:
        located = df.select(*[col(c) for c in df.columns], *block)
    except AnalysisException as error:
        raise PlumblineError("rows have an order of their own only where they come straight from files") from error
    stored = materialize(located.withColumn("__place", F.monotonically_increasing_id()))
    blocks = stored.groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__place").alias("first")).orderBy("__file", "__block")
    starts, total = [], 0
    for row in blocks.toLocalIterator():  # one row per block of a file
        starts.append((row["__file"], row["__block"], total - row["first"]))
        total += row["n"]
    shifts = small_table(df.sparkSession, starts, "__file string, __block bigint, __shift bigint")
    placed = stored.join(shifts, ["__file", "__block"])
    return placed.select(*[col(c) for c in df.columns], (F.col("__place") + F.col("__shift")).alias(name))
