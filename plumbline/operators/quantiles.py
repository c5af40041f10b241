"""Exact quantiles from a few bounded histograms, whatever the size of the table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import floor, isfinite
from sys import float_info

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.states import merged_states

BUCKETS = 1024
_SKETCH_ACCURACY = 10_000
_MAX_PASSES = 60


@dataclass(frozen=True)
class Extent:
    """How many values a column has and between which two they lie."""

    count: int
    low: float | None
    high: float | None


@dataclass
class _Search:
    """The value at one rank of one column, known to lie in [low, high] after ``below`` smaller values."""

    column: str
    rank: int
    low: float
    high: float
    count: int
    below: int = 0
    zoom: tuple[float, float] | None = None
    found: float | None = None

    def settle(self) -> None:
        place = self.rank - self.below
        if self.low == self.high or place == 0:
            self.found = self.low
        elif place == self.count - 1:
            self.found = self.high

    @property
    def range(self) -> tuple:
        return self.column, self.low, self.high, self.zoom or (self.low, self.high)


def exact_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    extents: Mapping[str, Extent],
    probs: Sequence[float],
    buckets: int = BUCKETS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, in the order of ``probs``; None for empty columns.

    ``values`` maps names to double expressions free of NaN. Each pass counts
    the values between the current bounds in equal-width buckets and keeps the
    least and greatest value of each; the bucket that holds the wanted rank
    gives the next bounds. A pass is one scan for all columns, in which every
    task keeps one histogram per range, however large or skewed the table is;
    later passes read only the blocks that can hold values between the bounds.
    If one bucket holds most values, a sketch points the next pass to the
    right place.
    """
    wanted, searches = {}, {}
    for name in values:
        n, low, high = extents[name].count, extents[name].low, extents[name].high
        for prob in probs if n else ():
            place = prob * (n - 1)
            rank = floor(place)
            pair = (rank, min(rank + 1, n - 1))
            wanted[name, prob] = (*pair, place - rank)
            for r in pair:
                searches.setdefault((name, r), _Search(name, r, low, high, n)).settle()

    for _ in range(_MAX_PASSES):
        pending = [s for s in searches.values() if s.found is None]
        if not pending:
            break
        _narrow(df, values, pending, buckets)
    else:
        raise RuntimeError("quantile search did not settle")

    def interpolate(name: str, prob: float) -> float | None:
        if (name, prob) not in wanted:
            return None
        rank, after, weight = wanted[name, prob]
        first, second = searches[name, rank].found, searches[name, after].found
        return first + weight * (second - first) if weight else first

    return {name: [interpolate(name, p) for p in probs] for name in values}


def _buckets(values: np.ndarray, zoom: tuple[float, float], buckets: int) -> np.ndarray:
    """Bucket numbers that never fall as the value grows: 0 below the zoom, then 1, 2, ..."""
    low, high = max(zoom[0], -float_info.max), min(zoom[1], float_info.max)
    with np.errstate(all="ignore"):
        if isfinite(high - low):
            width = (high - low) / buckets
            place = (values - low) / width if width else np.zeros(len(values))
        else:
            width = high / buckets - low / buckets
            place = values / width - low / width
    inside = np.clip(np.floor(place), 0, buckets - 1).astype(np.int64) + 1
    return np.where(values < low, 0, np.where(values > high, buckets + 1, inside))


def _histograms(ranges: Sequence[tuple], columns: Sequence[str], buckets: int):
    """A task's counts, least and greatest values per bucket, for every range."""
    own: dict[int, list[int]] = {}
    for r, (name, *_) in enumerate(ranges):
        own.setdefault(columns.index(name), []).append(r)

    def collect(batches: Iterator[pa.RecordBatch]) -> dict[int, bytes]:
        found = np.zeros((len(ranges), 3, buckets + 2))
        found[:, 1], found[:, 2] = np.inf, -np.inf
        for batch in batches:
            for i, numbers in own.items():
                values = batch.column(i).to_numpy(zero_copy_only=False)
                for r in numbers:
                    _, low, high, zoom = ranges[r]
                    inside = values[(values >= low) & (values <= high)]
                    if len(inside):
                        place = _buckets(inside, zoom, buckets)
                        found[r, 0] += np.bincount(place, minlength=buckets + 2)
                        np.minimum.at(found[r, 1], place, inside)
                        np.maximum.at(found[r, 2], place, inside)
        return {r: found[r].tobytes() for r in range(len(ranges)) if found[r, 0].any()}

    return collect


def _summed(states: list[bytes]) -> bytes:
    found = np.array([np.frombuffer(s).reshape(3, -1) for s in states])
    return np.array([found[:, 0].sum(axis=0), found[:, 1].min(axis=0), found[:, 2].max(axis=0)]).tobytes()


def _between(value: Column, searches: Sequence[_Search]) -> Column:
    bounds = sorted({(s.low, s.high) for s in searches})
    return reduce(lambda a, b: a | b, [value.between(low, high) for low, high in bounds])


def _by_column(searches: Sequence[_Search]) -> dict[str, list[_Search]]:
    found: dict[str, list[_Search]] = {}
    for s in searches:
        found.setdefault(s.column, []).append(s)
    return found


def _narrow(df: DataFrame, values: Mapping[str, Column], pending: Sequence[_Search], buckets: int) -> None:
    """One scan for all columns: histograms keyed (range, bucket) of the values between the bounds."""
    ranges = sorted({s.range for s in pending})
    number = {r: i for i, r in enumerate(ranges)}
    columns = list(_by_column(pending))
    # The scan is told of every column's bounds, so that blocks which hold none of the values are skipped.
    inside = reduce(lambda a, b: a | b, [_between(values[name], searches) for name, searches in _by_column(pending).items()])
    rows = df.where(inside).select(*[values[name].alias(f"v{i}") for i, name in enumerate(columns)])
    histograms: dict[int, list[tuple]] = {}
    for r, state in merged_states(rows, _histograms(ranges, columns, buckets), _summed).items():
        counts, lows, highs = np.frombuffer(state).reshape(3, -1)
        full = np.flatnonzero(counts)
        histograms[r] = list(zip(counts[full].astype(np.int64).tolist(), lows[full].tolist(), highs[full].tolist()))

    stuck = []
    for s in pending:
        before, upto = s.count, s.below
        for n, low, high in histograms[number[s.range]]:
            if upto + n > s.rank:
                s.below, s.count, s.low, s.high, s.zoom = upto, n, low, high, None
                break
            upto += n
        s.settle()
        if s.found is None and s.count > before / 2:
            stuck.append(s)
    if stuck:
        _point(df, values, stuck)


def _point(df: DataFrame, values: Mapping[str, Column], stuck: Sequence[_Search]) -> None:
    """Let sketches say where, between its bounds, the rank of each search lies; one scan for all columns."""
    slack = 2.0 / _SKETCH_ACCURACY
    sketches = []
    for i, s in enumerate(stuck):
        value, share = values[s.column], (s.rank - s.below) / s.count
        around = [max(share - slack, 0.0), min(share + slack, 1.0)]
        within = F.when(value.between(s.low, s.high), value)
        sketches.append(F.percentile_approx(within, around, F.lit(_SKETCH_ACCURACY)).alias(f"s{i}"))
    inside = reduce(lambda a, b: a | b, [_between(values[name], searches) for name, searches in _by_column(stuck).items()])
    for s, points in zip(stuck, df.where(inside).agg(*sketches).first()):
        s.zoom = (points[0], points[1])
