"""Isolation forest (Liu, Ting, Zhou: Isolation Forest, ICDM 2008).

Each tree is grown from a small random sample, so growing is bounded whatever
the table's size; scoring is one pass over the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col

TREES = 100
SAMPLE_ROWS = 256

_TREE_SCHEMA = "tree int, feature binary, value binary, left binary"
_HASH_RANGE = float(1 << 53)


def expected_depth(rows) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``rows`` entries."""
    n = np.asarray(rows, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays of the nodes they have; ``roots`` says where each begins.

    An inner node holds its feature and its split, and its left child stands
    at ``left``, the right one behind it. A leaf holds its path length as
    ``value`` and is its own ``left``.
    """

    features: tuple[str, ...]
    node_feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    roots: np.ndarray
    levels: int
    sample_rows: int

    def score(self, points: np.ndarray, block: int = 8192) -> np.ndarray:
        """Minus the anomaly score: near -1 for isolated points, above -0.5 for common ones."""
        out = np.empty(len(points))
        for start in range(0, len(points), block):
            part = np.ascontiguousarray(points[start : start + block])
            flat, base = part.ravel(), np.arange(len(part)) * part.shape[1]
            total = np.zeros(len(part))
            for root in self.roots:
                node = np.full(len(part), root, dtype=np.intp)
                for _ in range(self.levels):
                    child = self.left.take(node)
                    right = flat.take(base + self.node_feature.take(node)) >= self.value.take(node)
                    node = child + (right & (child > node))
                total += self.value.take(node)
            mean = total / len(self.roots)
            out[start : start + block] = -np.exp2(-mean / max(float(expected_depth(self.sample_rows)), 1e-12))
        return out

    @cached_property
    def complete(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, split and path length of complete trees, whose node i has the children 2i+1 and 2i+2.

        A node that stopped early sends every point left down to the last level.
        For looking into small forests: it has a slot for every node that could be.
        """
        shape = (len(self.roots), 2 ** (self.levels + 1) - 1)
        feature, split, depth = np.zeros(shape, dtype=np.intp), np.full(shape, np.inf), np.zeros(shape)
        for tree, root in enumerate(self.roots):
            work = [(0, int(root), 0)]
            while work:
                slot, node, level = work.pop()
                child = int(self.left[node])
                if child > node:
                    feature[tree, slot], split[tree, slot] = self.node_feature[node], self.value[node]
                    work += [(2 * slot + 1, child, level + 1), (2 * slot + 2, child + 1, level + 1)]
                else:
                    depth[tree, 2 ** (self.levels - level) * (slot + 1) - 1] = self.value[node]
        return feature, split, depth

    feature = property(lambda self: self.complete[0])
    split = property(lambda self: self.complete[1])
    depth = property(lambda self: self.complete[2])


def _unit_hash(*parts: Column) -> Column:
    """A repeatable pseudo-random number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(_HASH_RANGE)


def draw_samples(
    df: DataFrame,
    key_cols: Sequence[str],
    features: Sequence[str],
    n_rows: int,
    pool_share: float,
    trees: int,
    sample_rows: int,
    seed: int,
) -> DataFrame:
    """(tree, f0, f1, ...): up to ``sample_rows`` rows per tree, drawn by hash.

    A row's draw depends on its key only, so any partitioning gives the same
    samples. Rows are thinned to about one pool of trees x sample_rows before
    they meet the trees, and tasks pass on ``sample_rows`` rows per tree at
    most.
    """
    keys = [col(k).cast("string") for k in key_cols]
    share = min(1.0, pool_share, 1.2 * trees * sample_rows / max(n_rows, 1))
    pool = df.select(F.struct(*keys).alias("k"), *[col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    if share < 1.0:
        pool = pool.where(_unit_hash(F.lit(seed), F.col("k")) < share)
    per_tree = min(1.0, 2.0 * sample_rows / max(n_rows * share, 1.0))
    drawn = (
        pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        .withColumn("u", _unit_hash(F.lit(seed), F.col("tree"), F.col("k"), F.lit("draw")))
        .where(F.col("u") < per_tree)
    )
    order = Window.partitionBy("tree").orderBy("u", "k")
    return (
        drawn.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= sample_rows)
        .select("tree", "place", *[f"f{i}" for i in range(len(features))])
    )


def grow_tree(points: np.ndarray, levels: int, rng: np.random.Generator) -> list[tuple[int, int, float, float]]:
    """Nodes (node, feature, split, depth) of a tree of at most ``levels`` levels of splits, parents first.

    Node i has the children 2i+1 and 2i+2; a leaf has an infinite split and its path length as depth.
    """
    nodes: list[tuple[int, int, float, float]] = []
    leaf_depth = expected_depth(np.arange(len(points) + 1)).tolist()
    work = [(0, np.arange(len(points)), 0)]
    while work:
        node, rows, level = work.pop()
        part = points[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if level >= levels or len(rows) <= 1 or not len(varying):
            nodes.append((node, 0, np.inf, level + leaf_depth[len(rows)]))
            continue
        feature = int(rng.choice(varying))
        split = float(rng.uniform(low[feature], high[feature]))
        split = split if split > low[feature] else float(high[feature])
        goes_left = part[:, feature] < split
        nodes.append((node, feature, split, 0.0))
        work += [(2 * node + 1, rows[goes_left], level + 1), (2 * node + 2, rows[~goes_left], level + 1)]
    return nodes


def _packed(nodes: list[tuple[int, int, float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, value and left child of the nodes as a forest has them, level by level."""
    ordered = sorted(nodes)
    place = {node: k for k, (node, *_) in enumerate(ordered)}
    feature = np.array([f for _, f, _, _ in ordered], np.int32)
    value = np.array([d if s == np.inf else s for _, _, s, d in ordered])
    left = np.array([place.get(2 * n + 1, k) for k, (n, *_) in enumerate(ordered)], np.int32)
    return feature, value, left


def fit_forest(
    df: DataFrame,
    key_cols: Sequence[str],
    features: Sequence[str],
    n_rows: int,
    pool_share: float = 1.0,
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 42,
) -> Forest:
    """Grow all trees as one grouped job. ``df`` must have no null or NaN in ``features``.

    What comes back is at most 2 ``sample_rows`` nodes of 16 bytes per tree, whatever the table's size.
    """
    psi = min(sample_rows, max(n_rows, 1))
    levels = int(np.ceil(np.log2(max(psi, 2))))
    names = [f"f{i}" for i in range(len(features))]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        grown = []
        for tree, rows in pdf.sort_values(["tree", "place"]).groupby("tree"):
            nodes = grow_tree(rows[names].to_numpy(dtype=float), levels, np.random.default_rng([seed, int(tree)]))
            grown.append((tree, *[part.tobytes() for part in _packed(nodes)]))
        return pd.DataFrame(grown, columns=["tree", "feature", "value", "left"])

    samples = draw_samples(df, key_cols, features, n_rows, pool_share, trees, psi, seed)
    # Few rows but much work: an own partitioning keeps the trees apart, which would else share one task.
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = samples.withColumn("grove", F.pmod(F.col("tree"), F.lit(trees))).repartition(min(trees, cores), "grove")
    packed = spread.groupBy("grove").applyInPandas(grow, _TREE_SCHEMA).toLocalIterator()
    grown = sorted((r.tree, *(np.frombuffer(part, kind) for part, kind in ((r.feature, np.int32), (r.value, float), (r.left, np.int32)))) for r in packed)
    roots = np.cumsum([0, *[len(t[1]) for t in grown]])[:-1] if grown else np.zeros(0, int)
    feature, value, left = (np.concatenate([t[k] for t in grown]) if grown else np.zeros(0) for k in (1, 2, 3))
    left = left + np.repeat(roots, [len(t[1]) for t in grown]).astype(np.int32) if grown else left
    return Forest(tuple(features), feature, value, left, roots, levels, psi)


def score_column(df: DataFrame, forest: Forest, present: Column) -> Column:
    """The forest score where ``present``, else null. Other columns never leave the JVM."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            points = batch.to_numpy(dtype=float)
            usable = np.isfinite(points).all(axis=1)
            out = np.full(len(points), np.nan)
            if usable.any():
                out[usable] = model.score(points[usable])
            yield pd.Series(out).where(usable, None)

    values = F.struct(*[col(c).cast("double").alias(f"f{i}") for i, c in enumerate(forest.features)])
    scored = score(values)
    return F.when(present, scored)
