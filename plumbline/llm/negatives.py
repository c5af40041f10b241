"""Hard negatives by anchor spanning-tree bounds.

The anchors of a block and the origin are joined by a minimum spanning tree of
their distances. For a candidate c the score with an anchor differs from the
score with the anchor's parent by c times the edge, so by the edge's length
times c's norm at most; at the origin every score is 0. Walking the tree from
the origin, each task has bounds for all its candidates before it measures any,
and measures only those whose bounds overlap the window that can still change
the answer: above the worst positive kept so far, or between the worst
negative kept and the positive.

A block's anchors and their few positives are all that travels; candidates are
measured where they are read, in bounded numbers, and tasks give at most the
rows asked for per anchor. Windows over these rows merge them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import blocks_of, one_thread, picked
from plumbline.llm.exact_dedup import _arrow_type
from plumbline.session import materialize, ship_package, small_table

#: Numbers up to here are exact as doubles.
_EXACT = 2.0**53


@dataclass(frozen=True)
class Mining:
    """``positives`` of an anchor and ``negatives`` of a positive; ``percent`` of the positive's score that a negative
    has at least; components count as floor(``scale`` * x); components of a block of anchors; candidates measured together."""

    positives: int = 5
    negatives: int = 5
    percent: int = 80
    scale: float = 256.0
    anchor_components: int = 1 << 17
    rows: int = 2048


def spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """(point, parent, edge length) in an order that has parents first; -1 is the origin, from which the tree grows (Prim)."""
    n = len(points)
    near, parent = np.sqrt((points * points).sum(axis=1)), np.full(n, -1)
    waiting, out = np.ones(n, bool), []
    for _ in range(n):
        k = int(np.argmin(np.where(waiting, near, np.inf)))
        waiting[k] = False
        out.append((k, int(parent[k]), float(near[k])))
        away = points - points[k]
        away = np.sqrt((away * away).sum(axis=1))
        closer = waiting & (away < near)
        near[closer], parent[closer] = away[closer], k
    return out


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` integers; shorter ones end in zeros, further components meet zeros of the anchors."""
    lengths = np.asarray(pc.list_value_length(lists))
    values = np.asarray(lists.flatten())
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = column < width
    out[row[inside], column[inside]] = values[inside]
    return out


class Bounds:
    """Walks the tree over a set of candidates and keeps bounds of their scores with the anchors still needed."""

    def __init__(self, anchors: np.ndarray, tree, candidates: np.ndarray):
        self.anchors, self.tree, self.whole = anchors, tree, candidates
        self.rows = candidates.astype(np.float64)
        # A little is added for the rounding of norms and lengths.
        self.norms = np.sqrt((self.rows * self.rows).sum(axis=1)) * (1 + 1e-9)
        largest = float(np.abs(self.rows).max(initial=0))
        self.safe = largest * float(np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0)) < _EXACT
        self.children = Counter(parent for _, parent, _ in tree)
        zero = np.zeros(len(candidates))
        self.at = {-1: (zero, zero)}

    def walk(self):
        """Anchor, least and greatest score of every candidate; both may be tightened before the next is asked for."""
        for k, parent, length in self.tree:
            low, high = self.at[parent]
            slack = length * (1 + 1e-9) * self.norms + 1e-3
            reach = float(np.sqrt((self.anchors[k].astype(np.float64) ** 2).sum())) * (1 + 1e-9) * self.norms + 1e-3
            low, high = np.maximum(low - slack, -reach), np.minimum(high + slack, reach)
            if self.children[k]:
                self.at[k] = low, high
            yield k, low, high
            self.children[parent] -= 1
            if not self.children[parent]:
                del self.at[parent]

    def measure(self, k: int, chosen: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Exact scores of the chosen candidates with anchor k, which become their bounds."""
        if self.safe:
            scores = (self.rows[chosen] @ self.anchors[k].astype(np.float64)).astype(np.int64)
        else:
            scores = (self.whole[chosen].astype(object) @ self.anchors[k].astype(object)).astype(np.int64)
        low[chosen] = high[chosen] = scores
        return scores


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Which are the ``k`` of the highest score, ties by place."""
    if len(scores) > 4 * k:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= worst)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((places[some], -scores[some]))[:k]]


class _Kept(dict):
    """The best (score, id) of every key, at most ``most`` of them."""

    def __init__(self, most: int):
        self.most = most

    def bar(self, key, least):
        held = self.get(key, ())
        return max(least, held[-1][0]) if len(held) == self.most else least

    def add(self, key, scores, ids) -> None:
        new = [*self.get(key, ()), *zip(scores, ids)]
        self[key] = sorted(new, key=lambda e: (-e[0], e[1]))[: self.most]


@dataclass
class _Block:
    """What tasks need of a block of anchors; ``positives`` of each, as scores, once they are known."""

    ids: pa.Array
    labels: pa.Array
    points: np.ndarray
    tree: list
    positives: list[list[int]] | None = None


def _candidate_sets(batches, block: _Block, rows: int):
    """ids, labels as the anchors' numbers and a matrix of integers, of bounded numbers of candidates, ordered by id."""
    names = block.labels.unique()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            part = part.take(pc.sort_indices(part.column("id")))
            label = pc.fill_null(pc.index_in(part.column("label"), value_set=names), -1)
            yield part.column("id"), np.asarray(label), matrix(part.column("vector"), block.points.shape[1])


def _measured(block: _Block, options: Mining, most: int, choose):
    """A task function; ``choose`` has (kept, anchor, label is the anchor's, bounds) and adds to ``kept``."""

    def run(batches):
        one_thread()
        kept = _Kept(most)
        own = np.asarray(pc.index_in(block.labels, value_set=block.labels.unique()))
        for ids, labels, vectors in _candidate_sets(batches, block, options.rows):
            bounds = Bounds(block.points, block.tree, vectors)
            for k, low, high in bounds.walk():
                choose(kept, k, labels == own[k], ids, bounds, low, high)
        rows = [(*key, *entry) for key, entries in kept.items() for entry in entries]
        if rows:
            anchor, place, score, other = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int32()), pa.array(place, pa.int32()), pa.array(score, pa.int64()), pa.array(other, block.ids.type)],
                ["anchor", "place", "score", "id"],
            )

    return run


def _others(ids: pa.Array, chosen: np.ndarray, own: pa.Scalar) -> np.ndarray:
    return np.asarray(pc.not_equal(ids.take(pa.array(chosen)), own))


def _choose_positives(block: _Block, options: Mining):
    least = -(1 << 63)

    def choose(kept, k, same, ids, bounds, low, high):
        bar = kept.bar((k, 0), least)
        chosen = np.flatnonzero(same & (high >= bar))
        if not len(chosen):
            return
        scores = bounds.measure(k, chosen, low, high)
        fit = np.flatnonzero(_others(ids, chosen, block.ids[k]) & (scores >= bar))
        best = fit[_best(scores[fit], fit, options.positives)]
        if len(best):
            kept.add((k, 0), scores[best].tolist(), ids.take(pa.array(chosen[best])).to_pylist())

    return choose


def _choose_negatives(block: _Block, options: Mining):
    def choose(kept, k, same, ids, bounds, low, high):
        windows = [(p, kept.bar((k, p), -(-options.percent * score // 100)), score) for p, score in enumerate(block.positives[k])]
        windows = [w for w in windows if w[1] <= w[2]]
        if not windows:
            return
        reached = (high >= min(w[1] for w in windows)) & (low <= max(w[2] for w in windows))
        chosen = np.flatnonzero(~same & reached)
        if not len(chosen):
            return
        scores = bounds.measure(k, chosen, low, high)
        other = _others(ids, chosen, block.ids[k])
        for p, bar, top in windows:
            fit = np.flatnonzero(other & (scores >= bar) & (scores <= top))
            best = fit[_best(scores[fit], fit, options.negatives)]
            if len(best):
                kept.add((k, p), scores[best].tolist(), ids.take(pa.array(chosen[best])).to_pylist())

    return choose


def _merged(rows: DataFrame, block: _Block, options: Mining, most: int, choose, kind: str) -> DataFrame:
    found = rows.mapInArrow(_measured(block, options, most, choose), f"anchor int, place int, score long, id {kind}")
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    options: Mining = Mining(),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components count as floor(scale * x), scores are inner products of these
    integers. Of each row that the condition ``anchors`` (on ``id_col``)
    names, the positives are the first rows of its label by falling score, then
    rising id; a positive's negatives are the first rows of other labels whose
    score lies between ``percent`` of the positive's and the positive's.

    Rows without an id, a label or a vector, or with a component that is null
    or not finite, take no part. A row is no partner of its own id, so rows
    that repeat an id never meet; as anchors each gives its results. Vectors of
    different length are compared as if the shorter ended in zeros. Scores must
    fit 64 bits. Anchors with no positives, positives with no negatives and
    empty tables give nothing. Anchors are read and answered in blocks.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    vector, broken = F.col(f"`{vector_col}`"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(options.scale) * x).cast("long"))
    # Under their own names, as ``anchors`` speaks of the id; other columns, of whatever name, are left behind.
    vectors = picked(vectors, **{c: c for c in (id_col, label_col, vector_col)})
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), whole.alias("vector"), anchors.alias("is_anchor"), F.exists(vector, broken).alias("broken"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT broken").drop("broken")
    types = {f.name: f.dataType for f in rows.schema}
    kind, arrow = types["id"].simpleString(), {c: _arrow_type(types[c]) for c in ("id", "label")}
    out = None
    for held, _ in blocks_of(rows.where("is_anchor").toLocalIterator(), options.anchor_components, lambda r: len(r.vector) + 1):
        width = max(len(r.vector) for r in held)
        points = np.array([[*r.vector, *[0] * (width - len(r.vector))] for r in held], np.int64).reshape(len(held), width)
        block = _Block(pa.array([r.id for r in held], arrow["id"]), pa.array([r.label for r in held], arrow["label"]), points, spanning_tree(points.astype(np.float64)))
        candidates = rows.select("id", "label", "vector")
        # At most ``positives`` rows for each anchor of the block.
        found = _merged(candidates, block, options, options.positives, _choose_positives(block, options), kind).collect()
        positives: list[list] = [[] for _ in held]
        for r in sorted(found, key=lambda r: (r.anchor, r.rank)):
            positives[r.anchor].append((r.id, r.score))
        block.positives = [[score for _, score in one] for one in positives]
        named = [(k, p, held[k].id, i, s) for k, one in enumerate(positives) for p, (i, s) in enumerate(one)]
        if not named:
            continue
        names = small_table(spark, named, f"anchor int, place int, anchor_id {kind}, positive_id {kind}, positive_score long")
        negatives = _merged(candidates, block, options, options.negatives, _choose_negatives(block, options), kind)
        answer = materialize(
            negatives.join(F.broadcast(names), ["anchor", "place"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        )
        out = answer if out is None else out.unionByName(answer)
    if out is None:
        out = spark.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    return out
