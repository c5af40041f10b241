import pytest

from plumbline.errors import PlumblineError
from plumbline.operators.casts import cast_rates
from plumbline.operators.correlation import correlation_matrix
from plumbline.operators.profile import profile, profile_issues
from plumbline.operators.statistics import categorical_stats, compute_stats, numeric_stats
from plumbline.operators.validate import QualityRules, duplicate_counts, quick_validate, validate
from pyspark.sql import functions as F


@pytest.fixture
def clean(spark):
    return spark.createDataFrame(
        [(1, 10.0, "north", True), (2, 20.0, "south", False), (3, 30.0, "east", True), (4, 40.0, "west", True), (5, 50.0, "north", False)],
        "id bigint, revenue double, region string, active boolean",
    )


@pytest.fixture
def sparse(spark):
    return spark.createDataFrame(
        [(1, None, "a", None), (2, None, None, None), (3, None, None, None), (4, 4.0, "d", None)],
        "id bigint, value double, label string, all_null string",
    )


def by_column(found):
    return {r["column_name"]: r for r in found}


def test_profile_of_clean_table(clean, rows):
    got = by_column(rows(profile(clean), "position"))
    assert list(got) == ["id", "revenue", "region", "active"]
    assert got["region"]["unique_count"] == 4 and got["region"]["samples"] == ["east", "north", "south", "west"]
    assert got["revenue"]["samples"] == ["10.0", "20.0", "30.0", "40.0", "50.0"]
    assert all(r["null_rate"] == 0.0 and not r["nullable"] and r["row_count"] == 5 for r in got.values())


def test_profile_counts_null_as_a_value(sparse, rows):
    got = by_column(rows(profile(sparse)))
    assert got["value"]["null_rate"] == 0.75 and got["value"]["nullable"] and got["value"]["unique_count"] == 2
    assert got["all_null"]["unique_count"] == 1 and got["all_null"]["samples"] == []


@pytest.mark.parametrize("distinct", ["exact", "approx"])
def test_profile_of_empty_table(clean, rows, distinct):
    got = rows(profile(clean.where("false"), distinct), "position")
    assert [r["row_count"] for r in got] == [0] * 4 and [r["null_rate"] for r in got] == [0.0] * 4
    assert rows(profile_issues(profile(clean.where("false")))) == []


def test_approximate_profile(clean, rows):
    got = by_column(rows(profile(clean, "approx")))
    assert got["region"]["unique_count"] == 4 and got["region"]["is_approx"]
    assert set(got["region"]["samples"]) <= {"north", "south", "east", "west"}


@pytest.mark.parametrize("n", [100_000, 100_001])
def test_profile_does_not_depend_on_size(spark, rows, n):
    many = spark.range(n).selectExpr("id", "concat('k', id) AS key", "cast(id % 7 AS string) AS word")
    profiled = profile(many)
    got = by_column(rows(profiled))
    assert got["key"]["unique_count"] == n and got["word"]["unique_count"] == 7 and not any(g["is_approx"] for g in got.values())
    assert any("likely an ID" in r["message"] for r in rows(profile_issues(profiled)))


def test_samples_of_sketched_columns_are_the_smallest_values(spark, rows):
    df = spark.sql("SELECT IF(id < 4, NULL, concat('v', id % 6)) AS w, id % 3 AS n FROM range(50)")
    got = by_column(rows(profile(df, "approx")))
    assert got["w"]["samples"] == ["v0", "v1", "v2", "v3", "v4"] and got["n"]["samples"] == ["0", "1", "2"]


def test_two_hundred_columns_are_measured_in_one_scan(spark):
    wide = spark.range(30).select(*[(F.col("id") * k).cast("string").alias(f"c{k}") for k in range(200)])
    plan = cast_rates(wide)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 30") == 1
    assert cast_rates(wide).where("integers = 30").count() == 200


def test_nested_types_have_a_profile(spark, rows):
    df = spark.sql("SELECT map('a', 1) AS m, array(1, 2) AS a, struct(1 AS x) AS s UNION ALL SELECT map('a', 1), array(2), NULL")
    got = by_column(rows(profile(df)))
    assert [got[c]["unique_count"] for c in "mas"] == [1, 2, 2]
    assert rows(duplicate_counts(df)) == [{"rows": 2, "distinct_rows": 2}]


def test_profile_issues(spark, sparse, rows):
    issues = rows(profile_issues(profile(sparse)), "position", "severity")
    assert [(i["column_name"], i["severity"]) for i in issues] == [("value", "warning"), ("all_null", "error"), ("all_null", "warning")]
    assert issues[0]["message"] == "75% null values (3/4 rows)" and issues[0]["affected_rows"] == 3
    ids = spark.range(100).selectExpr("concat('k', id) AS uuid", "cast(id % 5 AS string) AS digits")
    assert [(i["column_name"], i["message"][:16]) for i in rows(profile_issues(profile(ids)), "position")] == [
        ("uuid", "High-cardinality"), ("digits", "Column 'digits' ")
    ]


def test_few_unique_rows_are_no_ids(spark, rows):
    assert rows(profile_issues(profile(spark.range(10).selectExpr("concat('k', id) AS uuid")))) == []


def test_structure_checks(clean, rows):
    assert rows(validate(clean)) == []
    assert rows(validate(clean.where("false")))[0]["message"] == "DataFrame is empty (0 rows)"
    few = rows(validate(clean, QualityRules(min_rows=10)))
    assert [(i["severity"], i["affected_rows"]) for i in few] == [("warning", 5)]
    assert [i["severity"] for i in rows(validate(clean.select()))] == ["error"]


def test_null_checks(sparse, rows):
    got = by_column(rows(validate(sparse, checks=["nulls"])))
    assert {c: i["severity"] for c, i in got.items()} == {"value": "warning", "all_null": "error"}
    strict = by_column(rows(validate(sparse, QualityRules(null_thresholds={"label": 0.4, "value": 0.8}), ["nulls"])))
    assert set(strict) == {"label", "all_null"}
    assert rows(validate(sparse.where("false"), checks=["nulls"])) == []


def test_column_and_type_checks(clean, rows):
    rules = QualityRules(required_columns=["id", "gone"], expected_types={"id": "INT64", "revenue": "Int64", "gone": "Utf8", "region": "string"})
    got = rows(validate(clean, rules), "check_order")
    assert [(i["check_name"], i["column_name"], i["severity"]) for i in got] == [
        ("required_columns", "gone", "error"), ("expected_types", "revenue", "warning")
    ]


def test_range_checks(spark, rows):
    df = spark.createDataFrame([(-5, 0.0), (25, 0.5), (150, 1.2), (None, 0.8)], "age int, score double")
    rules = QualityRules(numeric_ranges={"age": (0, 120), "score": (0, 1), "gone": (0, 1)})
    got = rows(validate(df, rules, ["numeric_ranges"]), "position")
    assert [(i["column_name"], i["affected_rows"]) for i in got] == [("age", 1), ("age", 1), ("score", 1)]
    assert got[0]["message"] == "1 values below expected minimum (0)"


def test_duplicates(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "c")], "id int, value string")
    got = rows(validate(df))
    assert [(i["check_name"], i["affected_rows"], i["message"]) for i in got] == [("duplicates", 2, "40.0% duplicate rows (2/5)")]
    assert rows(validate(df.limit(1))) == []
    assert rows(validate(df, QualityRules(max_duplicate_rate=0.4))) == []


def test_all_checks_run_in_order(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (1, None)], "a int, b string")
    rules = QualityRules(min_rows=5, required_columns=["z"], expected_types={"a": "Utf8"}, numeric_ranges={"a": (2, 3)})
    assert [i["check_order"] for i in rows(validate(df, rules), "check_order", "position")] == [0, 1, 2, 3, 4, 5]
    assert len(rows(quick_validate(df, ["z"]))) == 3


def test_numeric_stats(spark, rows):
    df = spark.createDataFrame(
        [(100.0, 1), (150.0, 2), (200.0, 3), (250.0, 4), (300.0, 5), (175.0, 6), (125.0, 7), (225.0, None)],
        "revenue double, units bigint",
    )
    got = by_column(rows(numeric_stats(df)))
    r = got["revenue"]
    assert (r["mean"], r["min"], r["max"], r["p25"], r["p50"], r["p75"]) == (190.625, 100.0, 300.0, 143.75, 187.5, 231.25)
    assert (got["units"]["count"], got["units"]["null_count"], got["units"]["p50"]) == (7, 1, 4.0)


def test_constant_single_and_empty_columns(spark, rows):
    df = spark.sql("SELECT 5.0D AS same, IF(id = 1, 7.0D, NULL) AS one, CAST(NULL AS double) AS none FROM range(4)")
    got = by_column(rows(numeric_stats(df)))
    assert got["same"]["std"] == 0.0 and got["one"]["std"] == 0.0 and got["one"]["p75"] == 7.0
    assert (got["none"]["count"], got["none"]["null_count"], got["none"]["mean"], got["none"]["p50"]) == (0, 4, None, None)


@pytest.mark.parametrize("buckets", [2, 16, 1024])
@pytest.mark.parametrize(
    "values",
    [
        [1.0] * 400 + [2.0] * 3 + [1e9, -1e9],
        [2.0**i for i in range(-500, 500, 3)],
        [(-1.0) ** i * 10.0 ** (i % 300) for i in range(501)],
        [1e15 + i / 8 for i in range(300)],
        [1.7e308, -1.7e308] + [float(i) for i in range(99)],
        [3.5],
        [float("inf")] + [0.25 * i for i in range(40)],
    ],
)
def test_quantiles_against_brute_force(spark, rows, values, buckets):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows(numeric_stats(df, buckets=buckets))[0]
    ordered = sorted(values)
    for name, prob in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        place = prob * (len(ordered) - 1)
        low = int(place)
        high = min(low + 1, len(ordered) - 1)
        want = ordered[low] + (place - low) * (ordered[high] - ordered[low]) if place > low else ordered[low]
        assert got[name] == pytest.approx(want, rel=1e-12)


def test_approximate_quantiles(spark, rows):
    got = rows(numeric_stats(spark.range(1001), quantiles="approx"))[0]
    assert got["p50"] == pytest.approx(500, abs=2)


def test_categorical_stats(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4), ("a", 5), ("b", 6), (None, 7)], "category string, n int")
    assert rows(categorical_stats(df)) == [
        {"position": 0, "column_name": "category", "dtype": "string", "count": 6, "null_count": 1, "top_values": ["a", "b", "c"]}
    ]


def test_stats_of_every_column(clean, rows):
    got = rows(compute_stats(clean), "position")
    assert [r["column_name"] for r in got] == clean.columns
    assert [r["mean"] is not None for r in got] == [True, True, False, False]
    assert got[3]["top_values"] == ["true", "false"]
    assert rows(compute_stats(clean.where("false"))) == []


def test_wide_tables_are_measured_in_groups(spark, rows):
    wide = spark.range(50).selectExpr(*[f"id * {k} AS c{k}" for k in range(1, 20)], "cast(id AS string) AS t")
    got = rows(numeric_stats(wide), "position")
    assert [r["p50"] for r in got] == [24.5 * k for k in range(1, 20)]
    matrix = rows(correlation_matrix(wide))
    assert len(matrix) == 19 * 19 and {r["correlation"] for r in matrix} == {1.0}


def test_decimal_counts_as_numeric(spark, rows):
    assert rows(numeric_stats(spark.sql("SELECT CAST(id AS decimal(20, 2)) AS d FROM range(3)")))[0]["mean"] == 1.0


def test_nan_is_left_out(spark, rows):
    got = rows(numeric_stats(spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "v double")))[0]
    assert (got["count"], got["mean"], got["max"], got["p50"]) == (3, 2.0, 3.0, 2.0)


def test_correlation(spark, rows):
    df = spark.sql("SELECT id AS x, 2.0 * id AS y, -id AS z, 1 AS k, IF(id > 3, NULL, id * id) AS s FROM range(8)")
    got = {(r["col_a"], r["col_b"]): r["correlation"] for r in rows(correlation_matrix(df))}
    assert len(got) == 25
    assert got["x", "x"] == 1.0 and got["x", "y"] == 1.0 and got["x", "z"] == -1.0 and got["z", "y"] == -1.0
    assert got["x", "k"] == 0.0 and got["k", "k"] == 0.0
    assert got["x", "s"] == got["s", "x"] == 0.9583
    with pytest.raises(PlumblineError):
        correlation_matrix(df, ["x"])
    with pytest.raises(ValueError):
        correlation_matrix(df, ["x", "gone"])


def test_two_hundred_columns_correlate_without_more_rows(spark, monkeypatch):
    """Every column in one scan: what leaves a task is one state, not a row per pair."""
    import numpy as np

    from plumbline.operators import correlation as module

    rng = np.random.default_rng(3)
    values = rng.normal(size=(400, 200))
    values[:, 1] += values[:, 0]
    values[rng.random(values.shape) < 0.1] = np.nan
    values[:, 7] = 5.0
    frame = spark.createDataFrame([tuple(map(float, r)) for r in values], ", ".join(f"c{i} double" for i in range(200)))
    seen = []
    real = module.merged_states
    monkeypatch.setattr(module, "merged_states", lambda rows, *rest: seen.append(rows) or real(rows, *rest))
    got = {(r.col_a, r.col_b): r.correlation for r in correlation_matrix(frame).collect()}
    assert len(got) == 200 * 200 and len(seen) == 1
    assert "Generate" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    for a, b in ((0, 1), (3, 50), (7, 8), (199, 0), (4, 4)):
        both = ~np.isnan(values[:, a]) & ~np.isnan(values[:, b])
        x, y = values[both, a], values[both, b]
        want = 0.0 if 7 in (a, b) else np.corrcoef(x, y)[0, 1]
        assert abs(got[f"c{a}", f"c{b}"] - want) < 6e-5


def test_correlation_of_empty_columns(spark, rows):
    frame = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert [r["correlation"] for r in rows(correlation_matrix(frame), "col_a", "col_b")] == [0.0, 0.0, 0.0, 1.0]
    assert {r["correlation"] for r in rows(correlation_matrix(frame.where("b > 5")))} == {0.0}


def test_forty_columns_take_four_scans_at_most(spark, monkeypatch):
    """One scan measures the columns, every pass of the quantile search is one for all of them."""
    import numpy as np

    from plumbline.operators import quantiles as module

    rng = np.random.default_rng(4)
    values = np.column_stack([rng.normal(size=5000), rng.lognormal(0, 3, 5000), rng.integers(0, 4, 5000), *rng.normal(size=(37, 5000))])
    frame = spark.createDataFrame([tuple(map(float, r)) for r in values], ", ".join(f"c{i} double" for i in range(40)))
    scans = []
    for name in ("_narrow", "_point"):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real, name=name: scans.append(name) or real(*a))
    got = {r.column_name: (r.p25, r.p50, r.p75) for r in numeric_stats(frame).collect()}
    for i in range(40):
        assert np.allclose(got[f"c{i}"], np.quantile(values[:, i], (0.25, 0.5, 0.75)), rtol=1e-12, atol=0)
    assert 1 + len(scans) <= 4, scans


def test_distinct_sketch_is_close_at_every_size():
    import numpy as np

    from plumbline.operators.sketches import Registers

    rng = np.random.default_rng(5)
    for n in (0, 1, 10, 1000, 6000, 12_000, 50_000, 400_000):
        sketch = Registers()
        hashes = rng.integers(-(1 << 63), (1 << 63) - 1, n)
        for part in np.array_split(np.r_[hashes, hashes], 7):
            sketch.add(part)
        assert abs(sketch.estimate() - n) <= 0.08 * n


def test_sketched_profile_is_one_scan(spark, monkeypatch):
    """The table is read once, and what tasks give does not grow with it."""
    from plumbline.operators import profile as module

    seen = []
    real = module.merged_states
    monkeypatch.setattr(module, "merged_states", lambda rows, *rest: seen.append(rows) or real(rows, *rest))
    frame = spark.range(0, 30_000, 1, 6).selectExpr(
        "id", "concat('t', id % 7000) AS t", "if(id % 3 = 0, null, cast(id as double) / 4) AS d", "cast(id % 5 as decimal(9,2)) AS m",
        "if(id % 2 = 0, double('nan'), -0.0D) AS z", "id % 2 = 0 AS b", "array(id % 3) AS a", "cast(null as string) AS none", "cast(id as string) AS n",
    )
    got = {r.column_name: r for r in module.profile(frame, distinct="approx").collect()}
    assert len(seen) == 1
    assert list(got["id"].samples) == ["0", "1", "2", "3", "4"] and list(got["t"].samples) == ["t0", "t1", "t10", "t100", "t1000"]
    assert list(got["d"].samples) == ["0.25", "0.5", "1.0", "1.25", "1.75"] and list(got["m"].samples) == ["0.00", "1.00", "2.00", "3.00", "4.00"]
    assert list(got["z"].samples) == ["0.0", "NaN"] and list(got["b"].samples) == ["false", "true"]
    assert list(got["a"].samples) == ['{"v":[0]}', '{"v":[1]}', '{"v":[2]}'] and list(got["none"].samples) == []
    assert (got["none"].null_count, got["none"].unique_count, got["none"].number_share) == (30_000, 1, None)
    assert (got["n"].number_share, got["t"].number_share, got["z"].unique_count, got["b"].unique_count) == (1.0, 0.0, 2, 2)
    assert got["d"].null_count == 10_000 and abs(got["t"].unique_count - 7000) < 560
