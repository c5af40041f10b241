import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.errors import DetectionError, DuplicateKeys, InsufficientData, PlumblineError
from plumbline.operators import charts
from plumbline.operators.anomalies import DetectionSettings, anomaly_rate, detect, detect_in_order, zscore_records
from plumbline.operators.findings import findings
from plumbline.operators.forest import _packed, draw_samples, expected_depth, fit_forest, grow_tree
from plumbline.operators.statistics import compute_stats
from plumbline.plans.analyse import analyse


def frame(spark, x, y=None):
    data = {"id": range(len(x)), "x": x}
    if y is not None:
        data["y"] = y
    return spark.createDataFrame(pd.DataFrame(data))


@pytest.fixture
def normal(spark):
    rng = np.random.default_rng(42)
    return frame(spark, rng.normal(100, 10, 50), rng.normal(50, 5, 50))


@pytest.fixture
def injected(spark):
    rng = np.random.default_rng(42)
    x, y = rng.normal(100, 10, 50), rng.normal(50, 5, 50)
    x[47:], y[47:] = [900, -500, 1000], [500, -100, 800]
    return frame(spark, x, y)


def test_few_flags_on_normal_rows(normal):
    assert detect(normal, ["id"], ["x", "y"]).records.count() <= 15


def test_injected_rows_are_found(injected, rows):
    got = rows(detect(injected, ["id"], ["x", "y"]).records, "id")
    assert {47, 48, 49} <= {r["id"] for r in got}
    assert all(-1.0 <= r["score"] < 0 for r in got)
    assert {r["method"] for r in got} <= {"ensemble", "isolation_forest", "zscore"}
    lowest = sorted(got, key=lambda r: r["score"])[:3]
    assert {r["id"] for r in lowest} == {47, 48, 49}


def test_zscore_flags_the_one_far_value(spark, rows):
    df = frame(spark, [100.0] * 19 + [1000.0])
    assert rows(zscore_records(df, ["id"])) == [
        {"id": 19, "column_name": "x", "value": 1000.0, "score": -1.0, "method": "zscore"}
    ]


def test_constant_and_short_columns_flag_nothing(spark):
    df = spark.sql("SELECT id, 5.0D AS same, IF(id < 2, id * 1e6, NULL) AS two FROM range(20)")
    assert zscore_records(df, ["id"], threshold=0.5).count() == 0


def test_nan_and_infinity_flag_nothing_by_themselves(spark, rows):
    values = [1.0] * 20 + [50.0, float("nan"), None]
    df = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    assert [r["id"] for r in rows(zscore_records(df, ["id"]))] == [20]
    infinite = spark.createDataFrame(list(enumerate([1.0] * 20 + [float("inf")])), "id long, x double")
    assert zscore_records(infinite, ["id"]).count() == 0


def test_first_column_over_the_threshold_is_reported(spark, rows):
    df = spark.sql("SELECT id, IF(id = 30, 99, id % 2) AS a, IF(id >= 30, 99, id % 2) AS b FROM range(32)")
    assert [(r["id"], r["column_name"]) for r in rows(zscore_records(df, ["id"]), "id")] == [(30, "a"), (31, "b")]


def test_many_columns(spark, rows):
    wide = spark.range(60).selectExpr("id", *[f"IF(id = {k}, 1e6, id * {k}) AS c{k}" for k in range(1, 20)])
    got = rows(zscore_records(wide, ["id"]), "id")
    assert [(r["id"], r["column_name"]) for r in got] == [(k, f"c{k}") for k in range(1, 20)]


def test_stricter_threshold_never_flags_more(injected):
    counts = [zscore_records(injected, ["id"], threshold=t).count() for t in (1.0, 2.0, 3.0, 5.0)]
    assert counts == sorted(counts, reverse=True)


def test_zscore_equals_numpy(spark, rows):
    x = np.random.default_rng(7).exponential(10, 2000)
    z = np.abs(x - x.mean()) / x.std()
    assert {r["id"] for r in rows(zscore_records(frame(spark, x), ["id"]))} == set(np.flatnonzero(z > 3))


def test_preconditions(spark, normal):
    with pytest.raises(InsufficientData):
        detect(frame(spark, [1.0, 2.0, 3.0]), ["id"])
    gaps = spark.sql("SELECT id, IF(id < 5, id, NULL) AS x FROM range(20)")
    with pytest.raises(InsufficientData):
        detect(gaps, ["id"])
    with pytest.raises(DetectionError):
        detect(normal, ["id"], settings=DetectionSettings(use_forest=False, use_z=False))
    words = spark.sql("SELECT id, 'w' AS label FROM range(10)")
    assert detect(words, ["id"]).records.count() == 0
    with pytest.raises(DuplicateKeys):
        detect(normal.unionByName(normal), ["id"])


def test_methods_can_be_switched(injected, rows):
    only_z = detect(injected, ["id"], settings=DetectionSettings(use_forest=False)).records
    assert {r["method"] for r in rows(only_z)} == {"zscore"} and {r["score"] for r in rows(only_z)} == {-1.0}
    only_forest = detect(injected, ["id"], settings=DetectionSettings(use_z=False)).records
    assert {r["method"] for r in rows(only_forest)} == {"isolation_forest"}


def test_contamination_sets_the_share(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, rng.normal(0, 1, 400), rng.normal(0, 1, 400))
    settings = DetectionSettings(contamination=0.05, use_z=False)
    assert detect(df, ["id"], settings=settings).records.count() == pytest.approx(20, abs=3)


def test_gaps_can_count_as_zero(spark, rows):
    df = spark.createDataFrame([(i, 1.0 + i % 3, 2.0 + i % 2) for i in range(60)] + [(60, None, 2.0), (61, None, None)], "id long, x double, y double")
    settings = DetectionSettings(use_z=False, contamination=0.99)
    scored = {r["id"] for r in rows(detect(df, ["id"], settings=settings).records)}
    filled = {r["id"] for r in rows(detect(df, ["id"], settings=DetectionSettings(use_z=False, contamination=0.99, fill_gaps=True)).records)}
    assert 60 not in scored and 60 in filled and 61 not in filled


def test_rows_with_gaps_have_no_score_but_can_be_far(spark, rows):
    x = [1.0 + 0.01 * i for i in range(40)] + [500.0, None]
    y = [2.0 + 0.01 * i for i in range(40)] + [None, 2.0]
    got = {r["id"]: r for r in rows(detect(spark.createDataFrame(list(zip(range(42), x, y)), "id long, x double, y double"), ["id"]).records)}
    assert got[40]["method"] == "zscore" and got[40]["score"] == -1.0
    assert 41 not in got


def test_detection_does_not_depend_on_partitioning(injected, rows):
    one, many = injected.coalesce(1), injected.repartition(7)
    assert rows(detect(one, ["id"]).records, "id") == rows(detect(many, ["id"]).records, "id")


def test_samples_are_bounded_and_distinct(spark, rows):
    df = spark.range(20_000).selectExpr("id", "cast(id AS double) AS x")
    got = draw_samples(df, ["id"], ["x"], 20_000, 1.0, 10, 64, 42).toPandas()
    assert (got.groupby("tree")["f0"].agg(["count", "nunique"]) == 64).all().all()
    assert abs(got["f0"].mean() - 10_000) < 1_500


def test_tree_leaves_hold_all_rows():
    points = np.random.default_rng(0).normal(size=(64, 2))
    nodes = grow_tree(points, 6, np.random.default_rng(1))
    assert len({n[0] for n in nodes}) == len(nodes)
    assert all(0 <= n[1] < 2 for n in nodes)
    assert [float(expected_depth(n)) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert float(expected_depth(256)) == pytest.approx(10.244770920119917)


def test_scores_equal_a_walk_through_the_nodes(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), **{f"c{i}": points[:, i] for i in range(3)}}))
    forest = fit_forest(df, ["id"], ["c0", "c1", "c2"], 300, trees=20, sample_rows=64)

    def walk(tree, point):
        node = 0
        for _ in range(forest.levels):
            node = 2 * node + (1 if point[forest.feature[tree, node]] < forest.split[tree, node] else 2)
        return forest.depth[tree, node]

    depths = [np.mean([walk(t, p) for t in range(20)]) for p in points]
    expected = -(2.0 ** (-np.array(depths) / float(expected_depth(64))))
    assert forest.score(points, block=7) == pytest.approx(expected)
    assert (forest.depth[forest.depth > 0] >= 1).all()


def test_forest_finds_most_injected_outliers(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, 3000), rng.normal(0, 1, 3000)
    x[:30] += rng.choice([-9, 9], 30)
    df = frame(spark, x, y)
    forest = fit_forest(df, ["id"], ["x", "y"], 3000)
    scores = forest.score(np.column_stack([x, y]))
    worst = np.argsort(scores)[:30]
    assert (worst < 30).mean() >= 0.75
    assert scores.min() > -1 and scores.max() < 0


def test_rate(injected, rows):
    records = zscore_records(injected, ["id"])
    got = rows(anomaly_rate(records, injected))[0]
    assert got["anomaly_rate"] == round(got["anomaly_count"] / 50, 4)
    assert rows(anomaly_rate(records.where("false"), injected.where("false")))[0]["anomaly_rate"] == 0.0


@pytest.fixture
def series(spark):
    return spark.createDataFrame(
        [(i, f"2024-01-0{i + 1}", v) for i, v in enumerate([10.0, 11.0, None, 99.0, 12.0])], "id long, date string, revenue double"
    )


def test_timeseries_overlay(series, rows):
    flagged = series.where("id IN (2, 3)")
    got = rows(charts.timeseries_data(series, "date", "revenue", ["id"], flagged), "x")
    assert [r["is_anomaly"] for r in got] == [False, False, False, True, False]
    assert not any(r["is_anomaly"] for r in rows(charts.timeseries_data(series, "date", "revenue")))
    with pytest.raises(ValueError):
        charts.timeseries_data(series, "date", "gone")


def test_scatter_drops_missing_points(series, rows):
    got = rows(charts.scatter_data(series, "id", "revenue", ["id"], series.where("id = 3")), "x")
    assert [(r["x"], r["status"]) for r in got] == [(0, "Normal"), (1, "Normal"), (3, "Anomaly"), (4, "Normal")]
    few = charts.scatter_data(series, "id", "revenue", ["id"], series.where("id = 3"), normal_share=0.0)
    assert rows(few) == [{"x": 3, "y": 99.0, "status": "Anomaly"}]


def test_histogram(spark, series, rows):
    got = rows(charts.histogram_data(spark.range(100), "id", 10), "bin")
    assert [r["count"] for r in got] == [10] * 10 and got[-1]["bin_end"] == 99.0
    assert rows(charts.histogram_data(spark.sql("SELECT 4 AS v FROM range(3)"), "v"))[0]["count"] == 3
    assert rows(charts.histogram_data(spark.range(0), "id")) == []
    with pytest.raises(PlumblineError):
        charts.histogram_data(series, "date")


def test_bars(spark, rows):
    df = spark.sql("SELECT IF(id % 7 = 0, NULL, concat('v', id % 5)) AS c FROM range(70)")
    got = rows(charts.bar_data(df, "c", 2))
    assert [r["value"] for r in got] == ["v0", "v1"] and len(got) == 2


def test_chart_choice(series, injected, spark):
    assert list(charts.auto_charts(series, ["id"])) == ["timeseries", "histogram"]
    assert list(charts.auto_charts(injected, ["id"])) == ["scatter", "histogram", "heatmap"]
    assert list(charts.auto_charts(injected, ["id"], max_charts=2)) == ["scatter", "histogram"]
    records = spark.createDataFrame([(5, "y"), (9, "x")], "id long, column_name string")
    data = charts.auto_charts(injected, ["id"], records)["histogram"]
    assert data.agg({"bin_end": "max"}).first()[0] == pytest.approx(800.0)


def test_findings(series, rows):
    stats = compute_stats(series)
    records = zscore_records(series, ["id"], threshold=1.5)
    texts = [r["finding"] for r in rows(findings(stats, records, ["id"]), "finding_order")]
    assert texts == [
        "Dataset contains 5 rows across 3 columns.",
        "1 anomalies detected (20.0% of rows).",
        "Most significant anomaly at row 3: revenue = 99.0 (score=-1.000).",
    ]
    none = rows(findings(stats, records.where("false"), ["id"]), "finding_order")
    assert none[1]["finding"] == "No anomalies detected in the dataset." and len(none) == 2


def test_findings_name_sparse_columns(spark, rows):
    df = spark.sql("SELECT id, IF(id < 6, NULL, id) AS a, IF(id < 4, NULL, 'x') AS b, CAST(NULL AS int) AS c FROM range(10)")
    records = zscore_records(df, ["id"], ["a"])
    texts = [r["finding"] for r in rows(findings(compute_stats(df), records, ["id"]), "finding_order")]
    assert texts[-1] == "Columns with >30% null values: a, b."


def test_whole_analysis(injected, rows):
    result = analyse(injected, ["id"])
    assert result.tier == "none" and result.warning is None
    assert set(result.charts) == {"scatter", "histogram", "heatmap"}
    assert result.records.count() >= 3 and result.stats.count() == 3
    assert rows(result.findings, "finding_order")[0]["finding"] == "Dataset contains 50 rows across 3 columns."


def test_analysis_of_a_short_table(spark):
    result = analyse(frame(spark, [1.0, 2.0, 3.0], [1.0, 2.0, 4.0]), ["id"])
    assert result.tier == "degraded" and "10 rows" in result.warning
    assert result.records.count() == 0 and len(result.charts) == 2


def test_bounded_time_series_keep_peaks_and_anomalies(spark):
    frame = spark.range(10_000).selectExpr(
        "id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS at", "IF(id = 7777, 50.0, IF(id % 4000 = 5, 999.0, sin(id))) AS v", "id % 4000 = 5 AS odd"
    )
    got = charts.timeseries_bounded(frame, "at", "v", max_points=25, flag=F.col("odd")).collect()
    normal = [r for r in got if not r.is_anomaly]
    assert len(normal) <= 100 and len(set(normal)) == len(normal) and max(r.y for r in normal) == 50.0
    assert sorted(r.y for r in got if r.is_anomaly) == [999.0] * 3
    assert min(r.x for r in normal).isoformat() == "2024-01-01T00:00:00" and max(r.x for r in normal).isoformat() == "2024-01-07T22:39:00"


def test_bounded_charts_of_odd_tables(spark):
    schema = "id long, day string, v double"
    none = spark.createDataFrame([], schema)
    assert charts.timeseries_bounded(none, "day", "v").count() == 0 and charts.scatter_grid(none, "id", "v").count() == 0
    few = spark.createDataFrame([(1, "2024-01-05", 2.0), (2, "no day", 3.0), (3, None, 1.0), (4, "2024-01-05", None), (5, "2024-01-05", 2.0)], schema)
    assert [tuple(r)[1:] for r in charts.timeseries_bounded(few, "day", "v").collect()] == [(2.0, False)]
    constant = spark.createDataFrame([(3, None, 1.0), (3, None, 1.0), (3, None, float("inf"))], schema)
    assert [tuple(r) for r in charts.scatter_grid(constant, "id", "v").collect()] == [(3.0, 1.0, 2, "Normal")]


def test_automatic_charts_are_bounded_and_join_once(spark):
    frame = spark.range(3000).selectExpr("id", "date'2024-01-01' + cast(id % 900 as int) AS day", "cast(id % 17 as double) AS a", "cast(id % 29 as double) AS b")
    records = frame.where("id IN (5, 2999)").selectExpr("id", "'a' AS column_name")
    got = charts.auto_charts(frame, ["id"], records, max_points=49)
    assert got["timeseries"].count() <= 4 * 49 + 2 and got["scatter"].where("status = 'Normal'").count() <= 49
    assert got["timeseries"].where("is_anomaly").count() == 2 and got["scatter"].where("status = 'Anomaly'").count() == 2
    for name in ("timeseries", "scatter"):
        plan = got[name]._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "id#" not in plan.split("FileScan")[-1]


def test_large_samples_make_small_forests():
    """A tree of 65,536 rows has 16 bytes for each node it has, so 100 of them fit a driver of 1.5 GB."""
    points = np.random.default_rng(3).normal(size=(1 << 16, 2))
    feature, value, left = _packed(grow_tree(points, 16, np.random.default_rng(1)))
    assert len(feature) <= 2 << 16 and 100 * (feature.nbytes + value.nbytes + left.nbytes) < 250e6
    inner = left > np.arange(len(left))
    assert set(left[inner]) | set(left[inner] + 1) | {0} == set(range(len(left)))


def test_records_in_row_order(spark):
    frame = spark.range(0, 2000, 1, 5).selectExpr("1999 - id AS back", "IF(id % 500 = 3, 900.0, sin(id)) AS v", "IF(id % 2 = 0, 'x', 'y') AS t")
    got = detect_in_order(frame, ["back"], ["v"], DetectionSettings(use_forest=False))
    assert [r.row_index for r in got.records.collect()] == [496, 996, 1496, 1996] and got.row_count == 2000
    both = detect_in_order(frame, ["back"], ["v"]).records
    positions = [r.row_index for r in both.collect()]
    assert positions == sorted(positions) and {496, 996, 1496, 1996} <= set(positions)
    assert both.columns == ["row_index", "column_name", "value", "score", "method"]
    ties = detect_in_order(frame, ["t"], ["v"], DetectionSettings(use_forest=False)).records
    assert ties.count() == 4 and ties.agg(F.count_distinct("row_index")).first()[0] == 4
    with pytest.raises(PlumblineError):
        detect_in_order(frame)
