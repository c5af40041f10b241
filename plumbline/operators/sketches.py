"""Bounded states of a column: a distinct-count sketch and the smallest distinct values."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Registers of the distinct-count sketch are 2 ** so many, for a deviation of 1.6 percent.
PRECISION = 12


class Registers:
    """HyperLogLog over 64-bit hashes."""

    def __init__(self, values: np.ndarray | None = None):
        self.values = np.zeros(1 << PRECISION, np.uint8) if values is None else values

    def add(self, hashes: np.ndarray) -> None:
        bits = hashes.view(np.uint64)
        rest = bits & np.uint64((1 << (64 - PRECISION)) - 1)
        length = np.frexp(rest.astype(np.float64))[1]
        rank = (64 - PRECISION + 1 - length).astype(np.uint8)
        np.maximum.at(self.values, (bits >> np.uint64(64 - PRECISION)).astype(np.int64), rank)

    def estimate(self) -> float:
        """The number of different hashes, by the maximum-likelihood-like estimator that needs no bias tables."""
        m, q = 1 << PRECISION, 64 - PRECISION
        counts = np.bincount(self.values, minlength=q + 2)
        z = m * _tail(1 - counts[q + 1] / m)
        for k in range(q, 0, -1):
            z = 0.5 * (z + counts[k])
        z += m * _head(counts[0] / m)
        return m * m / (2 * math.log(2) * z) if z < math.inf else 0.0


def _head(x: float) -> float:
    """Sum of x + 2**(k-1) * x**(2**k), for registers that saw nothing."""
    if x == 1.0:
        return math.inf
    total, power, step = x, x, 1.0
    while True:
        power *= power
        new = total + power * step
        if new == total:
            return total
        total, step = new, 2 * step


def _tail(x: float) -> float:
    """The like sum for registers that are full."""
    if x in (0.0, 1.0):
        return 0.0
    total, root, step = 1 - x, x, 1.0
    while True:
        root, step = math.sqrt(root), step / 2
        new = total - (1 - root) ** 2 * step
        if new == total:
            return total / 3
        total = new


def _order(value):
    return (True, 0) if value != value else (False, value)


@dataclass
class ColumnState:
    """What a profile needs to know of a column."""

    most: int
    rows: int = 0
    nulls: int = 0
    numbers: int = 0
    registers: Registers = field(default_factory=Registers)
    smallest: list = field(default_factory=list)

    def add(self, values: pa.Array, hashes: pa.Array, numbers: pa.Array | None) -> None:
        """``values`` (null where the column is), their hashes, and whether each reads as a number."""
        self.rows += len(values)
        self.nulls += values.null_count
        there = pc.is_valid(values)
        self.registers.add(np.asarray(hashes.filter(there)))
        if numbers is not None:
            self.numbers += pc.sum(numbers).as_py() or 0
        if not self.most:
            return
        found = values.drop_null()
        if len(self.smallest) == self.most and self.smallest[-1] == self.smallest[-1]:
            found = found.filter(pc.less(found, pa.scalar(self.smallest[-1], values.type)))
        if len(found):
            found = pc.unique(found)
            found = found.take(pc.sort_indices(found)[: self.most + 1])
            self.smallest = self._first([*self.smallest, *found.to_pylist()])

    def _first(self, values: list) -> list:
        ordered = sorted(values, key=_order)
        fresh = [v for k, v in enumerate(ordered) if k == 0 or _order(v) != _order(ordered[k - 1])]
        return fresh[: self.most]

    def pack(self) -> bytes:
        return pickle.dumps((self.most, self.rows, self.nulls, self.numbers, self.registers.values.tobytes(), self.smallest))

    @classmethod
    def unpack(cls, state: bytes) -> ColumnState:
        *counts, registers, smallest = pickle.loads(state)
        return cls(*counts, Registers(np.frombuffer(registers, np.uint8).copy()), smallest)

    def merge(self, other: ColumnState) -> None:
        self.rows += other.rows
        self.nulls += other.nulls
        self.numbers += other.numbers
        np.maximum(self.registers.values, other.registers.values, out=self.registers.values)
        self.smallest = self._first([*self.smallest, *other.smallest])


def collect_states(columns: int, texts: frozenset[int], most: int):
    """A task's states of the columns v0, v1, ... with hashes h0, ... and, for ``texts``, number flags n0, ..."""

    def collect(batches: Iterator[pa.RecordBatch]) -> dict[int, bytes]:
        states = {i: ColumnState(most) for i in range(columns)}
        for batch in batches:
            for i, state in states.items():
                state.add(batch.column(f"v{i}"), batch.column(f"h{i}"), batch.column(f"n{i}") if i in texts else None)
        return {i: s.pack() for i, s in states.items() if s.rows}

    return collect


def merge_states(states: list[bytes]) -> bytes:
    first, *others = map(ColumnState.unpack, states)
    for other in others:
        first.merge(other)
    return first.pack()
