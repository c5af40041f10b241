import math
import random

import numpy as np
import pytest

from plumbline.llm import negatives as N
from pyspark.sql import functions as F

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, options=N.Mining()):
    good = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, label, [math.floor(options.scale * x) for x in v]))
    out = []
    for i, label, v in good:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in good if j != i)
        positives = [(j, -s) for s, j, other in scored if other == label][: options.positives]
        for p, ps in positives:
            fit = [(j, -s) for s, j, other in scored if other != label and options.percent * ps <= -100 * s <= 100 * ps]
            out += [(i, p, n, j, ps, s) for n, (j, s) in enumerate(fit[: options.negatives], 1)]
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def table_of(spark, rows, vector="array<float>"):
    """With columns whose names clash with inner ones."""
    schema = f"vec_id bigint, label int, embedding {vector}, id string, vector string, is_anchor string, broken int, anchor int, place int, rank int, score int, LABEL int, c0 int"
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], schema)


def points(rng, n, width, spread=1.0):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(k, rng.randrange(3), [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for k in range(n)]


def every_tenth(spark):
    return F.col("vec_id") % 10 == 0


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_brute_force(spark, spread):
    rows = points(random.Random(5), 400, 6, spread)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    frame = table_of(spark, rows).repartition(3)
    for options in (N.Mining(), N.Mining(anchor_components=40, rows=37)):
        assert got(N.hard_negatives(frame, every_tenth(spark), options=options)) == want


def test_ties_by_smaller_id(spark):
    rows = [(k, k % 2, [1.0, 0.5]) for k in range(60)] + [(60 + k, k % 2, [0.9, 0.45]) for k in range(40)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert got(N.hard_negatives(table_of(spark, rows).repartition(4), every_tenth(spark))) == want


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = points(random.Random(6), 80, 3)
    rows += [(100, None, [1.0, 1.0, 1.0]), (110, 1, None), (120, 1, [1.0, None, 1.0]), (130, 1, [nan, 1.0, 1.0]), (140, 1, [inf, 0.0, 0.0]),
             (None, 1, [1.0, 1.0, 1.0]), (150, 2, []), (160, 2, [0.0, 0.0, 0.0]), (170, 2, [2.0]), (180, 1, [1.0, 1.0, 1.0, 9.0])]
    frame = table_of(spark, rows)
    assert got(N.hard_negatives(frame, every_tenth(spark))) == brute(rows, lambda i: i % 10 == 0)


def test_repeated_ids_never_meet(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0])]
    assert got(N.hard_negatives(table_of(spark, rows), every_tenth(spark))) == brute(rows, lambda i: i % 10 == 0)


def test_large_components_stay_exact(spark):
    rng = random.Random(7)
    rows = [(k, k % 2, [rng.uniform(1e5, 1e6) for _ in range(3)]) for k in range(40)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and max(r[4] for r in want) > 2**53
    assert got(N.hard_negatives(table_of(spark, rows, "array<double>"), every_tenth(spark))) == want


def test_nothing_to_answer(spark):
    assert got(N.hard_negatives(table_of(spark, []), every_tenth(spark))) == []
    assert got(N.hard_negatives(table_of(spark, [(1, 1, [1.0]), (2, 2, [1.0])]), every_tenth(spark))) == []
    assert got(N.hard_negatives(table_of(spark, [(10, 1, [1.0]), (2, 2, [1.0])]), every_tenth(spark))) == []


def test_tree_is_a_minimum_spanning_tree():
    rng = np.random.default_rng(8)
    nodes = np.r_[np.zeros((1, 4)), rng.normal(size=(60, 4))]
    tree = N.spanning_tree(nodes[1:])
    seen = {-1}
    for k, parent, length in tree:
        assert parent in seen and math.isclose(length, np.linalg.norm(nodes[k + 1] - nodes[parent + 1]))
        seen.add(k)
    edges = sorted((float(np.linalg.norm(nodes[a] - nodes[b])), a, b) for a in range(61) for b in range(a))
    group, total = list(range(61)), 0.0
    for length, a, b in edges:
        if group[a] != group[b]:
            total += length
            old = group[a]
            group = [group[b] if g == old else g for g in group]
    assert math.isclose(total, sum(t[2] for t in tree))


def test_bounds_hold_and_leave_candidates_out():
    rng = np.random.default_rng(9)
    anchors = (rng.normal(size=(1, 8)) * 200 + rng.normal(size=(30, 8)) * 4).astype(np.int64)
    candidates = (rng.normal(size=(500, 8)) * 200).astype(np.int64)
    bounds, measured = N.Bounds(anchors, N.spanning_tree(anchors.astype(float)), candidates), 0
    for k, low, high in bounds.walk():
        exact = candidates @ anchors[k]
        assert (low <= exact).all() and (exact <= high).all()
        chosen = np.flatnonzero(high >= np.sort(exact)[-5])
        assert np.array_equal(bounds.measure(k, chosen, low, high), exact[chosen])
        measured += len(chosen)
    assert measured < 0.5 * anchors.shape[0] * len(candidates)
