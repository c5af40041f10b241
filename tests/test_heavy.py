import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import heavy as H
from plumbline.operators.statistics import categorical_stats


def first(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda e: (-e[1], e[0]))[:k]


def frame_of(spark, columns):
    names = ", ".join(f"c{i} string" for i in range(len(columns)))
    return spark.createDataFrame(list(zip(*columns)), names).repartition(5)


def test_counters_are_too_low_by_the_error_at_most(monkeypatch):
    monkeypatch.setattr(H, "CAPACITY", 12)
    rng = random.Random(1)
    values = [f"v{min(int(rng.expovariate(0.05)), 400)}" for _ in range(4000)]
    whole = Counter(values)
    parts = []
    for start in range(0, 4000, 500):
        one = H.Summary()
        for at in range(start, start + 500, 100):
            one.add(pa.array(values[at : at + 100]))
        parts.append(one)
    total = parts[0]
    for other in parts[1:]:
        total.merge(other)
    assert len(total.counts) <= 12 and total.rows == 4000
    assert all(total.counts.get(v, 0) <= n <= total.counts.get(v, 0) + total.error for v, n in whole.items())


def test_few_texts_need_one_scan(spark, monkeypatch):
    scans = []
    real = H.merged_states
    monkeypatch.setattr(H, "merged_states", lambda *a: scans.append(1) or real(*a))
    rng = random.Random(2)
    columns = [[rng.choice(["a", "b", "c", None]) for _ in range(500)], [None] * 500]
    got = H.frequent_texts(frame_of(spark, columns), [F.col("c0"), F.col("c1")], 2)
    assert [g.first for g in got] == [first(columns[0], 2), []]
    assert (got[0].nulls, got[1].nulls, len(scans)) == (columns[0].count(None), 500, 1)


def test_frequent_texts_among_unique_ones_are_proven(spark, monkeypatch):
    """Two scans, and no text is shuffled."""
    monkeypatch.setattr(H, "CAPACITY", 16)
    rng = random.Random(3)
    values = [f"hot{rng.randrange(4)}" if rng.random() < 0.7 else f"unique{k}" for k in range(5000)]
    values.sort()
    seen = []
    real = H.merged_states
    monkeypatch.setattr(H, "merged_states", lambda rows, *rest: seen.append(rows) or real(rows, *rest))
    # The capacity of the tasks' own module stays at its default, so few texts are cut there.
    got = H.frequent_texts(frame_of(spark, [values]), [F.col("c0")], 3)
    assert got[0].first == first(values, 3) and len(seen) <= 2
    assert all("Exchange hashpartitioning(c0" not in rows._jdf.queryExecution().executedPlan().toString() for rows in seen)


@pytest.mark.parametrize("share", [0.0, 0.002, 0.3])
def test_statistics_are_right_with_and_without_a_proof(spark, rows, share):
    rng = random.Random(4)
    values = [f"hot{rng.randrange(6)}" if rng.random() < share else rng.choice([f"unique{k}", f"unique{k}", None]) for k in range(6000)]
    few = [rng.choice(["x", "y"]) for _ in values]
    got = rows(categorical_stats(frame_of(spark, [values, few])), "position")
    assert [r["column_name"] for r in got] == ["c0", "c1"]
    assert got[0]["top_values"] == [v for v, _ in first(values, 5)] and got[0]["null_count"] == values.count(None)
    assert got[1]["top_values"] == [v for v, _ in first(few, 5)] and got[1]["count"] == 6000


def test_unique_texts_are_not_guessed(spark):
    """All occur once, so no summary can tell which come first: every text is counted."""
    values = [f"u{k:05d}" for k in range(5000)]
    frame = frame_of(spark, [values])
    assert H.frequent_texts(frame, [F.col("c0")], 5)[0].first is None
    assert categorical_stats(frame).first()["top_values"] == values[:5]
