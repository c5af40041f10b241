"""Mergeable states: every task sums up its rows into a few small states, which are merged in two levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import ship_package

#: States of a key that are merged together on the first level.
SPREAD = 256


def merged_states(
    rows: DataFrame,
    collect: Callable[[Iterator[pa.RecordBatch]], dict[int, bytes]],
    merge: Callable[[list[bytes]], bytes],
) -> dict[int, bytes]:
    """The merged state of every key, after one scan of ``rows``.

    ``collect`` turns the Arrow batches of a task into one state per key and
    ``merge`` makes one of several; both run in tasks. States and keys must be
    few and bounded: a key's states are merged in groups of the tasks modulo
    ``SPREAD``, then those. The caller gets one state per key.
    """
    ship_package(rows.sparkSession)

    def summed(batches):
        states = collect(batches)
        if states:
            keys, values = zip(*states.items())
            part = TaskContext.get().partitionId() % SPREAD
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([part] * len(keys), pa.int32()), pa.array(values, pa.binary())], ["key", "part", "state"]
            )

    def together(table: pa.Table) -> pa.Table:
        states = table["state"].to_pylist()
        one = states[0] if len(states) == 1 else merge(states)
        return pa.table({"key": table["key"].slice(0, 1), "part": table["part"].slice(0, 1), "state": pa.array([one], pa.binary())})

    schema = T.StructType.fromDDL("key int, part int, state binary")
    found = rows.mapInArrow(summed, schema)
    found = found.groupBy("key", "part").applyInArrow(together, schema)
    found = found.withColumn("part", F.lit(0)).groupBy("key").applyInArrow(together, schema)
    return {r["key"]: bytes(r["state"]) for r in found.collect()}
