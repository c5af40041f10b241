import json
import math
from pathlib import Path

import pytest

from plumbline.errors import DuplicateKeys, LoadError, MissingColumns, PlumblineError
from plumbline.functions import columns as cl
from plumbline.functions import text as tx
from plumbline.operators import merge as mg
from plumbline.operators import report as rp
from plumbline.operators import rollup as ru
from plumbline.operators import scoring as sc
from plumbline.operators import usage as us
from plumbline.operators.anomalies import zscore_records
from plumbline.operators.keys import check_unique, with_row_index
from plumbline.operators.statistics import compute_stats
from plumbline.plans.ingest import describe, ingest
from plumbline.session import materialize, release
from plumbline.sources.sinks import write_report_tables
from plumbline.sources.spec import SourceSpec
from pyspark.sql import functions as F


def test_columns_by_type(spark):
    df = spark.sql(
        "SELECT 1 AS a, 1.5D AS b, 'x' AS created_at, true AS c, DATE'2024-01-01' AS d, TIMESTAMP'2024-01-01' AS e, 'y' AS counts, 'z' AS name"
    )
    assert cl.numeric_columns(df) == ["a", "b"]
    assert cl.time_columns(df) == ["created_at", "d", "e", "counts"]
    with pytest.raises(MissingColumns):
        cl.require_columns(df, ["a", "zz"])
    assert cl.canonical_type("Int64") == "bigint" and cl.canonical_type("UTF8") == "string"
    odd = spark.sql("SELECT 1 AS `a.b`")
    assert odd.select(cl.col("a.b")).first()[0] == 1


def test_row_index_is_contiguous(spark, rows):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS v").repartition(5)
    got = rows(with_row_index(df, ["v"]), "v")
    assert [r["row_index"] for r in got] == list(range(1000)) == [r["v"] for r in got]


def test_row_index_splits_equal_rows(spark, rows):
    df = spark.sql("SELECT IF(id < 700, 'hot', concat('k', id)) AS k FROM range(1000)")
    indexed = with_row_index(df, ["k"], unique=False)
    got = indexed.groupBy("k").agg(F.count("*").alias("n"), F.min("row_index").alias("a"), F.max("row_index").alias("b")).where("k = 'hot'").first()
    assert (got["n"], got["a"], got["b"]) == (700, 0, 699)
    assert indexed.select("row_index").distinct().count() == 1000
    assert with_row_index(df.where("false"), ["k"]).count() == 0


def test_unique_check(spark):
    check_unique(spark.range(5), ["id"])
    with pytest.raises(DuplicateKeys):
        check_unique(spark.range(5).union(spark.range(1)), ["id"])


def test_merge(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([("z", 3)], "v string, id int")
    assert rows(mg.merge([a, b]), "id") == [{"id": 1, "v": "x"}, {"id": 2, "v": "y"}, {"id": 3, "v": "z"}]
    assert mg.merge([a]) is a
    assert mg.merge([], spark=spark).columns == []
    text = spark.createDataFrame([("n/a", 4)], "id string, v int")
    mixed = mg.merge([a, text])
    assert mixed.dtypes == [("id", "string"), ("v", "string")] and mixed.count() == 3
    assert mg.merge([a.select("id"), spark.range(2)]).dtypes == [("id", "bigint")]
    c = spark.createDataFrame([(9, True), (8, False), (7, True)], "id int, w boolean")
    got = rows(mg.side_by_side([a, c], [["id"], ["id"]]), "row_index")
    assert [(r["id"], r["v"], r["id_1"], r["w"]) for r in got] == [(1, "x", 7, True), (2, "y", 8, False), (None, None, 9, True)]
    assert mg.merge([a, c], [["id"], ["id"]]).count() == 3
    with pytest.raises(PlumblineError):
        mg.merge([a, c])


def test_references(spark, rows):
    parent = spark.createDataFrame([("a",), ("b",)], "key string")
    child = spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "ref string")
    assert rows(mg.check_references(child, "ref", parent, "key")) == [{"value": "x", "affected_rows": 2}]
    plan = spark.createDataFrame([("t1", ["a"]), ("t2", ["a", "zz"]), ("t3", [])], "id string, depends_on array<string>")
    assert rows(mg.check_list_references(plan, "depends_on", parent, "key")) == [{"value": "zz", "affected_rows": 1}]


def test_word_count(spark):
    def count(text):
        return spark.createDataFrame([(text,)], "t string").select(tx.word_count(F.col("t"))).first()[0]

    assert count("# Title\n\nhello **big** world") == 4
    assert count("before ```json\n{ a lot of code }\n``` after") == 2
    assert count("") == 0 and count(None) == 0 and count("a_b | c-d") == 4


def test_sections(spark, rows):
    df = spark.createDataFrame([(1, "# T\nintro\n## One\n\nbody 1\n\n## Two"), (2, "")], "id int, t string")
    got = rows(tx.sections(df, ["id"], "t"), "id", "section_order")
    assert [(r["id"], r["section_order"], r["title"], r["content"]) for r in got] == [
        (1, 0, "Header", "# T\nintro"), (1, 1, "One", "body 1"), (1, 2, "Two", ""), (2, 0, "Header", "")
    ]


def test_json_responses(spark, rows):
    df = spark.createDataFrame(
        [(1, '```json\n{"a": 1}\n```'), (2, '{"a": 2}'), (3, "[1]"), (4, "not json"), (5, None), (6, "```\n{}\n```")], "id int, c string"
    )
    got = rows(tx.parse_json_object(df, "c").select("id", F.to_json("payload").alias("p"), "parse_error"), "id")
    assert [r["p"] for r in got] == ['{"a":1}', '{"a":2}', None, None, None, "{}"]
    assert [r["parse_error"] is None for r in got] == [True, True, False, False, False, True]
    lists = spark.createDataFrame([(1, '["a", "", null, "b", 3]'), (2, '{"a": 1}'), (3, "oops"), (4, "[]")], "id int, c string")
    assert [r["items"] for r in rows(tx.parse_json_list(lists, "c"), "id")] == [["a", "b", "3"], [], [], []]


def test_usage_metadata(spark, rows):
    raw = [
        {"llm_output": {"model": "m1", "usage": {"input_tokens": 10, "output_tokens": 5}}},
        {"llm_output": {"model_id": "m2", "token_usage": {"prompt_tokens": 7, "completion_tokens": 3}}},
        {"llm_output": {"model": ""}, "generation_info": {"model": "m3", "usage": {"input_tokens": 4, "output_tokens": 2}}},
        {"llm_output": {"usage": {"input_tokens": 0, "output_tokens": 0}}, "generation_info": {"usage": {"input_tokens": 8, "output_tokens": 1}}},
        {},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raw)], "id int, raw string")
    got = rows(us.usage_from_metadata(df, "raw"), "id")
    assert [(r["model"], r["input_tokens"], r["output_tokens"]) for r in got] == [
        ("m1", 10, 5), ("m2", 7, 3), ("m3", 4, 2), ("unknown", 8, 1), ("unknown", 0, 0)
    ]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(
        [("t", "planner", "big", 1000, 500, 0.003, 100.0), ("t", "etl", "small", 500, 300, 0.0005, 50.25), ("t", "etl", "small", 500, 200, 0.0003, 50.0)],
        "task_id string, agent_id string, model string, input_tokens long, output_tokens long, cost_usd double, latency_ms double",
    )


def test_usage_totals(log, rows):
    total = rows(us.task_totals(log))[0]
    assert math.isclose(total["cost_usd"], 0.0038) and (total["input_tokens"], total["output_tokens"], total["calls"]) == (2000, 1000, 3)
    agents = {r["agent_id"]: r for r in rows(us.agent_totals(log))}
    assert agents["planner"]["cost_usd"] == 0.003 and agents["etl"]["cost_usd"] == 0.0008 and agents["etl"]["latency_ms"] == 100.3
    parts = rows(us.cost_breakdown(log))
    assert len(parts) == 5 and sum(r["agent_id"] is None and r["model"] is None for r in parts) == 1
    assert [r["agent_id"] for r in rows(us.costs_by(log, "agent_id"))] == ["planner", "etl"]


def test_call_prices(spark, rows):
    prices = spark.createDataFrame([("big", 3.0, 15.0)], "model string, input_price double, output_price double")
    aliases = spark.createDataFrame([("big-latest", "big")], "alias string, model string")
    calls = spark.createDataFrame([("big", 1_000_000, 0), ("big-latest", 0, 1_000_000), ("who", 5, 5), ("big", 1, 1)], "model string, input_tokens long, output_tokens long")
    got = [(r["model"], r["cost_usd"]) for r in rows(us.price_calls(calls, prices, aliases), "model", "input_tokens")]
    assert got == [("big", 0.000018), ("big", 3.0), ("big-latest", 15.0), ("who", 0.0)]


# Published prices per million tokens and the typical token counts of one run.
LARGE, SMALL = ("large", 3.0, 15.0), ("small", 0.8, 4.0)
TYPICAL = [("planner", 600, 500), ("orchestrator", 0, 0), ("etl", 500, 300), ("analysis", 700, 500), ("report", 400, 250)]


def test_scenarios_match_the_published_estimate(spark, rows):
    prices = spark.createDataFrame([LARGE, SMALL], "model string, input_price double, output_price double")
    tokens = spark.createDataFrame(TYPICAL, "agent_id string, input_tokens long, output_tokens long")
    front = {"planner", "orchestrator"}
    plans = {
        "all_large": lambda a: "large", "mixed_routing": lambda a: "large" if a in front else "small", "all_small": lambda a: "small"
    }
    scenarios = spark.createDataFrame([(s, a, pick(a)) for s, pick in plans.items() for a, _, _ in TYPICAL], "scenario string, agent_id string, model string")
    totals = {r["scenario"]: r["estimated_cost_usd"] for r in rows(us.scenario_totals(us.scenario_costs(tokens, scenarios, prices)))}
    assert totals == {"all_large": 0.02985, "mixed_routing": 0.01478, "all_small": 0.00796}


def test_scenario_comparison(spark, rows):
    runs = spark.createDataFrame(
        [("all_large", "complete", 0.04, 100.0), ("all_large", "failed", 9.0, 300.0), ("mixed_routing", "complete", 0.01, 50.0), ("none", "failed", 1.0, 5.0)],
        "scenario string, status string, cost_usd double, latency_ms double",
    )
    got = {r["scenario"]: r for r in rows(us.compare_scenarios(runs))}
    assert (got["all_large"]["avg_cost_usd"], got["all_large"]["avg_latency_ms"], got["all_large"]["successful_runs"]) == (0.04, 200.0, 1)
    assert (got["mixed_routing"]["cost_ratio"], got["mixed_routing"]["saved_percent"]) == (0.25, 75.0)
    assert got["none"]["avg_cost_usd"] == 0.0 and got["none"]["cost_ratio"] is None


RUN_SCHEMA = (
    "task_id string, has_etl boolean, row_count long, columns array<string>, has_analysis boolean, anomaly_rate double, "
    "anomaly_count long, stats_count long, has_report boolean, content string, word_count long"
)
GOOD = (True, 120, ["date", "revenue", "units", "region"], True, 0.05, 6, 4, True, "## Executive Summary\n## Data Overview\n" + "word " * 60, 64)


@pytest.fixture
def expectations(spark):
    raw = spark.createDataFrame(
        [
            (t, json.dumps({"min_rows": 100, "max_rows": 200, "required_columns": ["date", "revenue", "units", "region"], "max_anomaly_rate": 0.2,
                            "min_anomaly_count": 1, "required_report_sections": ["Executive Summary", "data overview"], "min_word_count": 50}))
            for t in ("good", "bad", "gone", "many")
        ],
        "task_id string, j string",
    )
    schema = "struct<min_rows:long,max_rows:long,required_columns:array<string>,max_anomaly_rate:double,min_anomaly_count:long,required_report_sections:array<string>,min_word_count:long>"
    return sc.read_expectations(raw.select("task_id", F.from_json("j", schema[7:-1].replace(":", " ")).alias("expected")))


def test_run_scores(spark, expectations, rows):
    runs = spark.createDataFrame(
        [
            ("good", *GOOD),
            ("free", True, 0, [], True, 1.0, 0, 1, True, "x" * 60, 0),
            ("bad", True, 50, ["date"], True, 0.5, 0, 0, True, "short", 1),
            ("gone", False, None, None, False, None, None, None, False, None, None),
            ("many", True, 201, ["date", "revenue", "units", "region", "more"], *GOOD[3:]),
        ],
        RUN_SCHEMA,
    )
    got = {r["task_id"]: r for r in rows(sc.score_runs(runs, expectations))}
    assert got["good"]["total_score"] == 1.0 and got["good"]["passed"] and got["good"]["failures"] == []
    assert got["free"]["total_score"] == 1.0
    assert (got["bad"]["schema_score"], got["bad"]["analysis_score"], got["bad"]["report_score"]) == (0.0, 0.01, 0.0)
    assert got["bad"]["total_score"] == 0.004 and not got["bad"]["passed"]
    assert got["bad"]["failures"] == [
        "Row count 50 < required 100",
        "Missing required columns: ['revenue', 'units', 'region']",
        "Anomaly rate 50.00% > max 20.00%",
        "Detected 0 anomalies, expected >= 1",
        "No summary statistics generated",
        "Missing report sections: ['Executive Summary', 'data overview']",
        "Report word count 1 < required 50",
        "Report content appears empty or too short",
    ]
    assert got["gone"]["total_score"] == 0.0
    assert got["gone"]["failures"] == ["ETL result missing", "Analysis result missing", "Report result missing"]
    assert got["many"]["schema_score"] == 0.75 and got["many"]["failures"] == ["Row count 201 > max 200"]


def test_expectation_defaults(spark, rows):
    df = spark.createDataFrame([("t", (5,))], "task_id string, expected struct<min_rows:int>")
    got = rows(sc.read_expectations(df))[0]
    assert got["min_rows"] == 5 and got["max_rows"] is None and got["required_columns"] is None


def test_run_summary(spark, rows):
    schema = "status string, correctness_score double, cost_usd double, latency_ms double, passed boolean"
    df = spark.createDataFrame([("complete", 0.9, 0.01, 100.0, True), ("partial", 0.6, 0.02, 200.0, True), ("failed", 0.0, 0.0, 50.0, False)], schema)
    assert rows(sc.summarise_runs(df)) == [
        {"total_tasks": 3, "completion_rate": 0.6667, "avg_correctness": 0.5, "avg_cost_usd": 0.01, "avg_latency_ms": 116.7, "passed_count": 2, "failed_count": 1, "partial_count": 1}
    ]
    assert rows(sc.summarise_runs(df.where("false")))[0] == {
        "total_tasks": 0, "completion_rate": 0.0, "avg_correctness": 0.0, "avg_cost_usd": 0.0, "avg_latency_ms": 0.0, "passed_count": 0, "failed_count": 0, "partial_count": 0
    }


def test_run_records(spark, log, rows):
    runs = spark.createDataFrame([("t", "complete", 10, 2), ("u", "failed", 0, 1)], "task_id string, status string, row_count int, stored_at int")
    issues = spark.createDataFrame([("t", "error"), ("t", "warning"), ("t", "warning")], "task_id string, severity string")
    flags = spark.createDataFrame([("t",)], "task_id string")
    got = {r["task_id"]: r for r in rows(ru.run_rollup(runs, issues, flags, log, flags.where("false")))}
    t, u = got["t"], got["u"]
    assert (t["validation_error_count"], t["validation_warning_count"], t["anomaly_rate"], t["total_cost_usd"]) == (1, 2, 0.1, 0.0038)
    assert (u["anomaly_count"], u["total_cost_usd"], u["anomaly_rate"], u["error_count"]) == (0, 0.0, 0.0, 0)
    assert [r["task_id"] for r in rows(ru.recent_runs(runs, log))] == ["t", "u"]
    assert ru.recent_runs(runs, log, 1).count() == 1


def test_report_tables(spark, tmp_path, log, rows):
    df = spark.sql("SELECT id, IF(id = 39, 1e4, id % 3) AS v, IF(id < 30, NULL, concat('k', id % 4)) AS w FROM range(40)")
    profiled, issues = describe(df)
    records = zscore_records(df, ["id"], ["v"])
    errors = spark.createDataFrame([("etl", 1, "LoadError", "m" * 90, "degraded")], "agent_id string, attempt int, error_type string, message string, recovery_tier string")
    tables = rp.report_tables(profiled, issues, compute_stats(df), records, ["id"], usage=log, errors=errors, sources=["a", "b"], listings=True)
    assert rows(tables["overview"]) == [
        {"row_count": 40, "column_count": 3, "sources": "a, b", "validation_errors": 0, "validation_warnings": 2}
    ]
    assert [r["null_rate"] for r in rows(tables["schema_listing"], "position")] == ["0.0%", "0.0%", "75.0%"]
    assert [r["null_rate"] for r in rows(tables["schema"], "position")] == [0.0, 0.0, 0.75]
    assert rows(tables["anomaly_listing"])[0]["score"] == "-1.0000" and rows(tables["anomaly_listing"])[0]["not_shown"] == 0
    assert rows(tables["anomalies"])[0]["score"] == -1.0 and rows(tables["meta"])[0]["anomaly_rate"] == 0.025
    assert rows(tables["numeric_listing"], "position")[0]["median"] == "19.50"
    assert rows(tables["stats"], "position")[0]["p25"] == 9.75
    assert rows(tables["categorical_listing"])[0]["top_values"] == "k2, k3, k0"
    assert rows(tables["error_listing"])[0]["error"] == "LoadError: " + "m" * 80 + "..."
    assert rows(tables["errors"])[0]["message"] == "m" * 90
    assert [r["agent_id"] for r in rows(tables["cost_by_agent"])] == ["planner", "etl"]
    paths = write_report_tables(tables, str(tmp_path / "out"))
    assert set(paths) == set(tables) and spark.read.json(paths["overview"]).count() == 1


def test_anomaly_listing_is_cut(spark, rows):
    df = spark.sql("SELECT id, IF(id % 40 = 0, 500.0D, 1.0D) AS v FROM range(1000)")
    listed = rows(rp.anomaly_table(zscore_records(df, ["id"]), ["id"]))
    assert len(listed) == 20 and {r["not_shown"] for r in listed} == {5}


def test_ingest(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("id,price,flag\n1,10,yes\n2,N/A,no\n3,30,yes\n")
    (tmp_path / "b.csv").write_text("price,id,flag\n40,4,no\nbad,5,no\n")
    sources = [SourceSpec(str(tmp_path / n), source_id=n) for n in ("a.csv", "b.csv", "gone.csv")]
    with pytest.raises(LoadError):
        ingest(spark, sources)
    got = ingest(spark, sources, on_error="skip")
    assert got.data.count() == 5 and dict(got.data.dtypes)["id"] == "bigint"
    assert [r["tier"] for r in rows(got.status, "source_id")] == ["none", "none", "degraded"]
    assert got.profile.count() == 3


def test_materialized_data_is_kept_in_the_shared_folder(spark):
    stored = materialize(spark.range(10).withColumn("v", F.rand(1)))
    assert stored.count() == 10 and stored.inputFiles()[0].startswith("file:")
    assert spark.conf.get("spark.checkpoint.dir") in stored.inputFiles()[0]
    assert stored.agg(F.sum("v")).first() == stored.agg(F.sum("v")).first()


def test_copies_can_be_released(spark):
    stored = materialize(spark.range(10))
    folder = stored.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert Path(folder).exists()
    release(stored)
    assert not Path(folder).exists()
    with pytest.raises(ValueError):
        release(spark.read.parquet("/root/testdata/sf0.001/nation.parquet"))


def test_run_record_with_all_its_parts(spark, log, rows):
    runs = spark.createDataFrame([("t", 10), ("u", 0)], "task_id string, row_count int")
    none = spark.createDataFrame([], "task_id string, severity string")
    charts = spark.createDataFrame([("t",), ("t",)], "task_id string")
    found = spark.createDataFrame([("t", 1, "b"), ("t", 0, "a")], "task_id string, finding_order int, finding string")
    got = {r["task_id"]: r for r in rows(ru.run_rollup(runs, none, none, log, none, charts, found, by_agent=True))}
    assert got["t"]["chart_count"] == 2 and got["t"]["key_findings"] == ["a", "b"] and set(got["t"]["cost_by_agent"]) == {"planner", "etl"}
    assert got["u"]["chart_count"] == 0 and got["u"]["key_findings"] is None
