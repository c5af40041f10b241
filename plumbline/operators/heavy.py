"""The most frequent texts of columns, exactly, without counting every text.

Every task keeps at most ``CAPACITY`` counters per column (a Misra-Gries
summary): when there are more texts, the same amount is taken off all counters
and those that reach nothing are forgotten. What was taken off bounds how much
any count can be too low, and how often a forgotten text can have occurred. Summaries add up.

If nothing was taken off, the counters are the counts. Else a second scan
counts the texts that may be among the first, and they are if the last of them
occurs more often than a forgotten text can. Only columns where that proof fails need
every text counted.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from plumbline.operators.states import merged_states

CAPACITY = 1024


@dataclass
class Summary:
    """Counters of texts, each too low by ``error`` at most; rows, and how many of them are null."""

    rows: int = 0
    nulls: int = 0
    error: int = 0
    counts: dict[str, int] = field(default_factory=dict)

    def add(self, values: pa.Array) -> None:
        self.rows += len(values)
        self.nulls += values.null_count
        found = pc.value_counts(values.drop_null())
        texts, counts = found.field("values"), np.asarray(found.field("counts"))
        if len(counts) > CAPACITY:
            less = int(np.partition(counts, len(counts) - CAPACITY - 1)[len(counts) - CAPACITY - 1])
            kept = np.flatnonzero(counts > less)
            texts, counts = texts.take(pa.array(kept)), counts[kept] - less
            self.error += less
        self._merge(zip(texts.to_pylist(), counts.tolist()))

    def _merge(self, counts) -> None:
        for text, n in counts:
            self.counts[text] = self.counts.get(text, 0) + n
        if len(self.counts) > CAPACITY:
            less = sorted(self.counts.values(), reverse=True)[CAPACITY]
            self.counts = {t: n - less for t, n in self.counts.items() if n > less}
            self.error += less

    def merge(self, other: Summary) -> None:
        self.rows += other.rows
        self.nulls += other.nulls
        self.error += other.error
        self._merge(other.counts.items())

    def candidates(self, k: int) -> list[str]:
        """The texts whose counts may be among the ``k`` greatest."""
        ordered = sorted(self.counts.values(), reverse=True)
        least = ordered[k - 1] if len(ordered) >= k else 0
        return [t for t, n in self.counts.items() if n + self.error >= least]


def _summaries(columns: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> dict[int, bytes]:
        found = {i: Summary() for i in range(columns)}
        for batch in batches:
            for i, summary in found.items():
                summary.add(batch.column(i))
        return {i: pickle.dumps(s) for i, s in found.items() if s.rows}

    return collect


def _merged(states: list[bytes]) -> bytes:
    first, *others = map(pickle.loads, states)
    for other in others:
        first.merge(other)
    return pickle.dumps(first)


def _occurrences(wanted: Sequence[list[str]]):
    def collect(batches: Iterator[pa.RecordBatch]) -> dict[int, bytes]:
        sets = [pa.array(w, pa.string()) for w in wanted]
        found = [np.zeros(len(w), np.int64) for w in wanted]
        for batch in batches:
            for i, names in enumerate(sets):
                place = pc.index_in(batch.column(i).cast(pa.string()), value_set=names).drop_null()
                found[i] += np.bincount(np.asarray(place), minlength=len(names))
        return {i: f.tobytes() for i, f in enumerate(found)}

    return collect


def _added(states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(s, np.int64) for s in states], axis=0).tobytes()


@dataclass(frozen=True)
class Frequent:
    """Rows and nulls of a column, and its first texts with their counts; None where every text has to be counted."""

    rows: int
    nulls: int
    first: list[tuple[str, int]] | None


def frequent_texts(df: DataFrame, texts: Sequence[Column], k: int) -> list[Frequent]:
    """For each text expression the ``k`` most frequent texts that are not null, equal counts by text.

    One scan, and a second one for the expressions with more than ``CAPACITY``
    different texts; neither shuffles a text. Nothing is guessed: an expression
    whose first texts cannot be proven has None. That is so where they occur no more
    often than rows / ``CAPACITY``, as in a column of unique texts.
    """
    named = [t.alias(f"t{i}") for i, t in enumerate(texts)]
    found = {i: pickle.loads(s) for i, s in merged_states(df.select(*named), _summaries(len(named)), _merged).items()}
    summaries = [found.get(i, Summary()) for i in range(len(named))]
    counts: list[dict[str, int]] = [s.counts for s in summaries]
    open_ = [i for i, s in enumerate(summaries) if s.error and s.counts]
    if open_:
        wanted = [sorted(summaries[i].candidates(k)) for i in open_]
        exact = merged_states(df.select(*[named[i] for i in open_]), _occurrences(wanted), _added)
        for place, i in enumerate(open_):
            counts[i] = dict(zip(wanted[place], np.frombuffer(exact[place], np.int64).tolist()))
    out = []
    for summary, own in zip(summaries, counts):
        first = sorted(own.items(), key=lambda e: (-e[1], e[0]))[:k]
        proven = not summary.error or (len(first) == k and first[-1][1] > summary.error)
        out.append(Frequent(summary.rows, summary.nulls, first if proven else None))
    return out
