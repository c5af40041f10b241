"""Pearson correlation of numeric columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.errors import PlumblineError
from plumbline.functions.columns import as_double, numeric_columns, require_columns
from plumbline.operators.measures import measure
from plumbline.operators.states import merged_states
from plumbline.session import small_table


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long form (col_a, col_b, correlation), 4 places; a constant column gives 0.

    A pair uses the rows where both values are present. A first pass measures
    each column; a second one sends the scaled values (which keeps large means
    from cancelling digits) to tasks as blocks X with their masks M of present
    values, and sums X'X, X'M, (XX)'M and M'M: four small matrices per task
    hold all pairs, and no row is multiplied. Both passes run when it is called.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    require_columns(df, columns)
    if len(columns) < 2:
        raise PlumblineError(f"a correlation matrix needs at least 2 numeric columns, got {len(columns)}")
    types = {f.name: f.dataType for f in df.schema.fields}
    _, _, moments = measure(df, columns)
    scaled = []
    for i, c in enumerate(columns):
        value, m = as_double(c, types[c]), moments[c]
        one = (value - F.lit(m.mean)) / F.lit(m.sd) if m.sd else F.when(value.isNotNull(), F.lit(0.0))
        scaled.append(one.alias(f"v{i}"))
    states = merged_states(df.select(*scaled), _grams(len(columns)), _summed)
    r = _coefficients(states.get(0), len(columns))
    names = [(a, b, float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    found = small_table(df.sparkSession, names, "col_a string, col_b string, correlation double")
    return found.select("col_a", "col_b", F.round("correlation", 4).alias("correlation"))


def _grams(n: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> dict[int, bytes]:
        total = np.zeros((4, n, n))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
            there = ~np.isnan(x)
            x[~there] = 0.0
            m = there.astype(np.float64)
            total += (x.T @ x, x.T @ m, (x * x).T @ m, m.T @ m)
        return {0: total.tobytes()} if total[3].any() else {}

    return collect


def _summed(states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(s) for s in states], axis=0).tobytes()


def _coefficients(state: bytes | None, n: int) -> np.ndarray:
    """Correlations over the rows where both values are present."""
    if state is None:
        return np.zeros((n, n))
    products, sums, squares, counts = np.frombuffer(state).reshape(4, n, n)
    with np.errstate(all="ignore"):
        mean, square = sums / counts, squares / counts
        spread = np.sqrt(np.maximum(square - mean * mean, 0.0))
        r = (products / counts - mean * mean.T) / (spread * spread.T)
    return np.where(np.isfinite(r), r, 0.0)
