"""Windows over ordered rows of a key without a task that has to hold the key: a segmented scan.

Rows are range-partitioned by (key, order), so a busy key spreads over as many
ranges as its rows fill. Each task scans its range once and numbers, sums and
carries along the rows of every key from where its range begins. What a range
ends with (one row, or as many as a lag looks back) is all the next one needs;
these few rows are combined in order, and each range whose first key began
earlier is shifted by them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import PlumblineError
from plumbline.functions.columns import as_text, col, require_columns
from plumbline.session import materialize, ship_package


@dataclass(frozen=True)
class Measures:
    """What to add to every row, by new column name.

    ``row_number``: names of 1-based positions within the key. ``lag``: (column,
    how many rows back). ``last``: a column's latest value that is not null, this
    row's included. ``running_sum``: a number column's sum so far; null adds nothing.
    """

    row_number: Sequence[str] = ()
    lag: Mapping[str, tuple[str, int]] | None = None
    last: Mapping[str, str] | None = None
    running_sum: Mapping[str, str] | None = None

    @property
    def reach(self) -> int:
        return max([1, *(back for _, back in (self.lag or {}).values())])


_PART, _HEAD, _FIRST, _TAIL, _PLACE = "__part", "__head", "__first", "__tail", "__place"


def by_ranges(df: DataFrame, by: Sequence[str], order_by: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """``df`` in sorted ranges of (key, order)."""
    order = [*map(col, by), *[col(o) if isinstance(o, str) else o for o in order_by]]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def segmented_scan(
    df: DataFrame, by: Sequence[str], order_by: Sequence[Column | str], measures: Measures, partitions: int | None = None
) -> DataFrame:
    """``df`` with ``measures`` over the rows of each key ``by`` in the order ``order_by``.

    Null keys are one key. Rows that are equal in key and order are taken in
    any order, and are the only rows that cannot be dealt to several ranges, so
    end ``order_by`` with a unique column where there is one. ``partitions``
    is the number of ranges (default: the session's shuffle partitions).
    An empty table gives an empty result.
    """
    spark = df.sparkSession
    lag, last, sums = dict(measures.lag or {}), dict(measures.last or {}), dict(measures.running_sum or {})
    require_columns(df, [*by, *(c for c, _ in lag.values()), *last.values(), *sums.values()])
    if any(back < 1 for _, back in lag.values()):
        raise PlumblineError("a lag looks back one row or more")
    types = {f.name: f.dataType for f in df.schema.fields}
    sum_types = {new: _sum_type(types[c]) for new, c in sums.items()}
    ship_package(spark)
    keys = {f"__k{i}": _comparable(c, types[c]) for i, c in enumerate(by)}
    sources = {f"__s{i}": col(c).cast(sum_types[new]) for i, (new, c) in enumerate(sums.items())}
    keyed = by_ranges(df, by, order_by, partitions).withColumns({**keys, **sources})

    added = [T.StructField(new, types[c]) for new, (c, _) in lag.items()]
    added += [T.StructField(new, types[c]) for new, c in last.items()]
    added += [T.StructField(new, kind) for new, kind in sum_types.items()]
    edges = [T.StructField(_PART, T.IntegerType()), T.StructField(_HEAD, T.BooleanType()), T.StructField(_FIRST, T.BooleanType())]
    edges += [T.StructField(_TAIL, T.IntegerType()), T.StructField(_PLACE, T.LongType())]
    schema = T.StructType([*df.schema.fields, *[f for f in keyed.schema.fields if f.name in keys], *added, *edges])
    plan = _Plan(list(keys), lag, last, dict(zip(sums, sources)), measures.reach, df.columns)
    stored = materialize(keyed.mapInArrow(plan.scan, schema))

    shifts = _carried(stored, plan, added)
    names = [*lag, *last, *sums]
    numbered = [F.col(_PLACE).alias(n) for n in measures.row_number]
    if not shifts:
        return stored.select(*map(col, df.columns), *map(col, names), *numbered)
    carry_fields = [T.StructField("c_place", T.LongType())]
    carry_fields += [T.StructField(f"c_{new}", T.ArrayType(types[c])) for new, (c, _) in lag.items()]
    carry_fields += [T.StructField(f"c_{f.name}", f.dataType) for f in added[len(lag) :]]
    carries = spark.createDataFrame(shifts, T.StructType([T.StructField(_PART, T.IntegerType()), *carry_fields]))
    joined = stored.join(F.broadcast(carries), _PART, "left")  # one row for each range at most
    there = F.col(_HEAD) & F.col("c_place").isNotNull()
    shifted = []
    for new, (_, back) in lag.items():
        rows = F.col(f"`c_{new}`")
        from_before = F.get(rows, (F.size(rows) - back + F.col(_PLACE) - 1).cast("int"))
        shifted.append(F.when(there & (F.col(_PLACE) <= back), from_before).otherwise(col(new)).alias(new))
    for new in last:
        shifted.append(F.coalesce(col(new), F.when(there, F.col(f"`c_{new}`"))).alias(new))
    for new in sums:
        shifted.append(F.when(there, F.col(f"`c_{new}`") + col(new)).otherwise(col(new)).alias(new))
    place = F.when(there, F.col("c_place") + F.col(_PLACE)).otherwise(F.col(_PLACE))
    return joined.select(*map(col, df.columns), *shifted, *[place.alias(n) for n in measures.row_number])


def _sum_type(kind: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()


def _comparable(name: str, kind: T.DataType) -> Column:
    """The key in a form whose equality is that of Spark."""
    plain = (T.IntegralType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return col(name) if isinstance(kind, plain) else as_text(name, kind)


@dataclass(frozen=True)
class _Plan:
    """The scan of one range."""

    keys: list[str]
    lag: dict[str, tuple[str, int]]
    last: dict[str, str]
    sums: dict[str, str]
    reach: int
    columns: list[str]

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, held = TaskContext.get().partitionId(), _State(self), None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = state.step(batch, part)
            held = out if held is None else pa.concat_tables([held, out])
            if len(held) > self.reach:  # the last rows wait, as they may be the range's last
                yield from held.slice(0, len(held) - self.reach).to_batches()
                held = held.slice(len(held) - self.reach).combine_chunks()
        if held is not None:
            tail = pa.array(np.arange(len(held), 0, -1, dtype=np.int32))
            yield from held.set_column(held.column_names.index(_TAIL), _TAIL, tail).combine_chunks().to_batches()


class _State:
    """What a range has seen so far: the run of its latest key."""

    def __init__(self, plan: _Plan):
        self.plan, self.key, self.place, self.runs = plan, None, 0, 0
        self.recent: dict[str, pa.Array] = {}
        self.latest: dict[str, pa.Array] = {}
        self.totals: dict[str, float] = {}

    def step(self, batch: pa.RecordBatch, part: int) -> pa.Table:
        plan, n = self.plan, batch.num_rows
        keys = [batch.column(k) for k in plan.keys]
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= _differ(k)
        now = tuple(k[0].as_py() for k in keys)
        first = self.runs == 0
        new[0] = first or now != self.key
        run = np.cumsum(new)  # 0: the run that began in an earlier batch
        starts = np.r_[0, np.flatnonzero(new)]
        begin = starts[run]
        index = np.arange(n)
        place = index - begin + 1 + np.where(run == 0, self.place, 0)

        added = {}
        for name, (column, back) in plan.lag.items():
            values = batch.column(column)
            recent = self.recent.get(name, values.slice(0, 0))
            both = pa.concat_arrays([recent, values])
            at = np.where(place > back, index - back + len(recent), 0)
            added[name] = both.take(pa.array(at, mask=place <= back))
            self.recent[name] = both.slice(max(0, len(both) - back))
        for name, column in plan.last.items():
            values = batch.column(column)
            before = self.latest.get(name, pa.nulls(1, values.type))
            both = pa.concat_arrays([before, values])
            seen = np.maximum.accumulate(np.where(np.asarray(pc.is_valid(values)), index, -1))
            own = seen >= begin
            at = np.where(own, seen + 1, 0)
            added[name] = both.take(pa.array(at, mask=~own & (run > 0)))
            self.latest[name] = added[name].slice(n - 1)
        for name, column in plan.sums.items():
            values = batch.column(column)
            numbers = pd.Series(np.asarray(pc.fill_null(values, pa.scalar(0, values.type))))
            totals = numbers.groupby(run).cumsum().to_numpy()
            totals = totals + np.where(run == 0, self.totals.get(name, 0), 0).astype(totals.dtype)
            added[name] = pa.array(totals)
            self.totals[name] = totals[-1]

        self.key, self.place = tuple(k[n - 1].as_py() for k in keys), int(place[-1])
        head = self.runs + run == 1
        self.runs += int(run[-1])
        edges = {
            _PART: pa.array(np.full(n, part, np.int32)),
            _HEAD: pa.array(head),
            _FIRST: pa.array((index == 0) & first),
            _TAIL: pa.array(np.zeros(n, np.int32)),
            _PLACE: pa.array(place),
        }
        columns = {c: batch.column(c) for c in [*plan.columns, *plan.keys]}
        return pa.table({**columns, **added, **edges})


def _differ(values: pa.Array) -> np.ndarray:
    """Which values are not the one before; null is like null."""
    before, after = values.slice(0, len(values) - 1), values.slice(1)
    one_null = pc.xor(pc.is_null(before), pc.is_null(after))
    return np.asarray(pc.or_(pc.fill_null(pc.not_equal(before, after), False), one_null))


def _carried(stored: DataFrame, plan: _Plan, added: Sequence[T.StructField]) -> list[tuple]:
    """For each range whose first key began in an earlier one: (part, rows before, what lags, last values and sums carry)."""
    sources = {f"v_{n}": F.col(f"`{c}`") for n, (c, _) in plan.lag.items()}
    shown = [*map(F.col, (_PART, _HEAD, _FIRST, _TAIL, _PLACE, *plan.keys)), *[col(f.name) for f in added]]
    edge = stored.where(f"{_FIRST} OR {_TAIL} > 0").select(*shown, *[c.alias(n) for n, c in sources.items()])
    by_part: dict[int, list] = {}
    for row in edge.toLocalIterator():  # the first and the last ``reach`` rows of each range
        by_part.setdefault(row[_PART], []).append(row)
    shifts, key, held = [], None, None
    for part in sorted(by_part):
        rows = sorted(by_part[part], key=lambda r: (not r[_FIRST], -r[_TAIL]))
        first, tails = rows[0], [r for r in rows if r[_TAIL]]
        end = tails[-1]
        going_on = held is not None and key == tuple(first[k] for k in plan.keys)
        if going_on:
            shifts.append((part, held["place"], *held["recent"].values(), *held["last"].values(), *held["sums"].values()))
        run = [r for r in tails if r[_TAIL] <= end[_PLACE]]
        recent = {n: [r[f"v_{n}"] for r in run][-back:] for n, (_, back) in plan.lag.items()}
        new = {"place": end[_PLACE], "recent": recent, "last": {n: end[n] for n in plan.last}, "sums": {n: end[n] for n in plan.sums}}
        if going_on and end[_HEAD]:  # the whole range is one key
            new["place"] += held["place"]
            new["recent"] = {n: [*held["recent"][n], *new["recent"][n]][-back:] for n, (_, back) in plan.lag.items()}
            new["last"] = {n: held["last"][n] if v is None else v for n, v in new["last"].items()}
            new["sums"] = {n: held["sums"][n] + v for n, v in new["sums"].items()}
        key, held = tuple(end[k] for k in plan.keys), new
    return shifts
