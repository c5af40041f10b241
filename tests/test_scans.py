import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.errors import PlumblineError
from plumbline.operators.asof import asof_join
from plumbline.operators.scans import Measures, by_ranges, segmented_scan

MEASURES = Measures(
    row_number=["place"],
    lag={"one_back": ("label", 1), "three_back": ("number", 3)},
    last={"latest": "number", "pair": "nested"},
    running_sum={"total": "number", "share": "real"},
)


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[repr(r[0])].append(r)
    out = {}
    for group in groups.values():
        group.sort(key=lambda r: r[1])
        latest = pair = None
        total, share = 0, 0.0
        for k, (_, at, label, number, real, nested) in enumerate(group):
            latest = number if number is not None else latest
            pair = nested if nested is not None else pair
            total, share = total + (number or 0), share + (real or 0.0)
            one, three = group[k - 1][2] if k >= 1 else None, group[k - 3][3] if k >= 3 else None
            out[at] = (one, three, latest, pair, total, round(share, 6), k + 1)
    return out


SCHEMA = "key double, at int, label string, number int, real double, nested struct<a:int,b:string>"


@pytest.mark.parametrize("partitions", [1, 3, 17])
@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
def test_scan_equals_brute_force(spark, partitions, hot):
    rng = random.Random(partitions * 10 + int(hot * 2))
    keys = [None, float("nan"), 1.5, 2.5, -0.0, 7.0]
    rows = []
    for at in rng.sample(range(1000), 300):
        key = 3.5 if rng.random() < hot else rng.choice(keys)
        rows.append(
            (
                key, at, rng.choice([None, "a", "b"]), rng.choice([None, None, 1, 5, -3]), rng.choice([None, 0.25, 1e6]),
                rng.choice([None, (1, "x"), (None, None)]),
            )
        )
    done = segmented_scan(spark.createDataFrame(rows, SCHEMA), ["key"], ["at"], MEASURES, partitions)
    assert done.columns == ["key", "at", "label", "number", "real", "nested", "one_back", "three_back", "latest", "pair", "total", "share", "place"]
    got = {r.at: (r.one_back, r.three_back, r.latest, None if r.pair is None else tuple(r.pair), r.total, round(r.share, 6), r.place) for r in done.collect()}
    assert got == brute(rows)


def test_scan_of_an_empty_table(spark):
    done = segmented_scan(spark.createDataFrame([], SCHEMA), ["key"], ["at"], MEASURES)
    assert done.count() == 0 and "place" in done.columns


def test_a_hot_key_fills_no_task(spark):
    """Half of the rows have one key; no range gets twice what the others have."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("at"))
    sizes = [r["count"] for r in by_ranges(df, ["key"], ["at"], 16).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sorted(sizes)[8]
    places = segmented_scan(df, ["key"], ["at"], Measures(row_number=["place"]), 16).where("key = 0")
    assert places.agg(F.count_if(F.col("place") == F.col("at") / 2 + 1)).first()[0] == 10_000


def test_no_row_is_shuffled_twice(spark):
    df = spark.range(100).withColumn("key", F.col("id") % 3)
    plan = segmented_scan(df, ["key"], ["id"], Measures(row_number=["n"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_wrong_lags_and_columns_are_refused(spark):
    df = spark.range(3)
    with pytest.raises(PlumblineError):
        segmented_scan(df, ["id"], ["id"], Measures(lag={"x": ("id", 0)}))
    with pytest.raises(PlumblineError):
        segmented_scan(df, ["id"], ["id"], Measures(last={"x": "nope"}))


def plain_asof(left, right, strict):
    out = []
    for k, at, name in left:
        fit = [] if k is None or at is None else [r for r in right if r[0] == k and r[1] is not None and (r[1] < at or not strict and r[1] == at)]
        best = max(fit, key=lambda r: (r[1], r[2]), default=(None, None, None))
        out.append((k, at, name, best[1], best[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot", [0.2, 0.9])
def test_asof_equals_brute_force(spark, strict, hot):
    rng = random.Random(int(hot * 10))

    def side(n, ids):
        return [(rng.choice([None, 1, 2]) if rng.random() > hot else 9, rng.choice([None, *range(60)]), i) for i in ids(n)]

    left, right = side(300, range), side(80, lambda n: rng.sample(range(1000), n))
    a, b = spark.createDataFrame(left, "user int, at int, id int"), spark.createDataFrame(right, "user int, at int, id int")
    got = asof_join(a, b, ["user"], "at", ["id"], strict, partitions=9)
    assert got.columns == ["user", "at", "id", "at_right", "id_right"]
    want = plain_asof(left, right, strict)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    inner = asof_join(a, b, ["user"], "at", ["id"], strict, how="inner", partitions=4)
    assert sorted((tuple(r) for r in inner.collect()), key=repr) == [r for r in want if r[3] is not None]


def test_asof_without_rows(spark):
    a, b = spark.createDataFrame([(1, 5)], "k int, t int"), spark.createDataFrame([], "k int, t int, v string")
    assert [tuple(r) for r in asof_join(a, b, ["k"], "t").collect()] == [(1, 5, None, None)]
    assert asof_join(b, a, ["k"], "t").count() == 0
    with pytest.raises(PlumblineError):
        asof_join(a, b, ["k"], "t", how="outer")


def test_float_sums_do_not_leak_between_keys(spark):
    rows = [(k, i, 1e15 if k == 0 else 0.1) for k in range(3) for i in range(50)]
    done = segmented_scan(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], ["i"], Measures(running_sum={"t": "v"}), 5)
    assert all(math.isclose(r.t, 0.1 * (r.i + 1)) for r in done.where("k > 0").collect())
