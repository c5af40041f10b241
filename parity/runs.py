"""Usage cost, run scores, run records and text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity.registry import query, table
from plumbline.functions import text as tx
from plumbline.operators import report as rp
from plumbline.operators import scoring as sc
from plumbline.operators import usage as us
from plumbline.operators.anomalies import zscore_records
from plumbline.operators.findings import findings as make_findings
from plumbline.operators.rollup import recent_runs as newest
from plumbline.operators.rollup import run_rollup as roll_up
from plumbline.operators.statistics import compute_stats
from plumbline.operators.validate import validate
from plumbline.session import small_table

PRICES = [("big", 3.0, 15.0), ("small", 0.8, 4.0), ("tiny", 0.15, 0.6)]
ALIASES = [("big-latest", "big")]
SCENARIOS = [
    ("all_large", "system", "big"),
    ("all_large", "user", "big"),
    ("all_large", "assistant", "big"),
    ("mixed_routing", "system", "big"),
    ("mixed_routing", "user", "small"),
    ("mixed_routing", "assistant", "small"),
    ("all_small", "system", "small"),
    ("all_small", "user", "small"),
    ("all_small", "assistant", "tiny"),
    ("all_small", "critic", "tiny"),
]


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _prices(spark):
    return small_table(spark, PRICES, "model string, input_price double, output_price double")


def _aliases(spark):
    return small_table(spark, ALIASES, "alias string, model string")


def _calls(spark, sf_dir):
    """A usage log: every conversation turn as one call."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("task_id"),
        F.col("role").alias("agent_id"),
        F.expr("CASE role WHEN 'user' THEN 'big-latest' WHEN 'assistant' THEN 'small' ELSE 'unlisted' END").alias("model"),
        F.length("text").cast("bigint").alias("input_tokens"),
        (F.length("text") * 3 + F.col("turn")).cast("bigint").alias("output_tokens"),
        (F.col("turn") * 1.5 + 0.25).cast("double").alias("latency_ms"),
    )


def _usage(spark, sf_dir):
    return us.price_calls(_calls(spark, sf_dir), _prices(spark), _aliases(spark))


_USAGE = f"""prices(model, input_price, output_price) AS ({_values(PRICES)}), aliases(alias, model) AS ({_values(ALIASES)}),
calls AS (SELECT conv_id AS task_id, turn, role AS agent_id, CASE role WHEN 'user' THEN 'big-latest' WHEN 'assistant' THEN 'small' ELSE 'unlisted' END AS model,
  CAST(length(text) AS BIGINT) AS input_tokens, CAST(length(text) * 3 + turn AS BIGINT) AS output_tokens, CAST(turn * 1.5 + 0.25 AS DOUBLE) AS latency_ms FROM conversations),
usage AS (SELECT calls.*, coalesce(round(input_tokens / 1e6 * CAST(input_price AS DOUBLE) + output_tokens / 1e6 * CAST(output_price AS DOUBLE), 8), 0.0) AS cost_usd
  FROM calls LEFT JOIN aliases ON calls.model = alias LEFT JOIN prices p ON p.model = coalesce(aliases.model, calls.model))"""


@query(f"WITH {_USAGE} SELECT task_id, agent_id, model, input_tokens, output_tokens, latency_ms, round(cost_usd, 8) AS cost_usd FROM usage")
def usage_cost(spark, sf_dir):
    return _usage(spark, sf_dir)


_SUMS = """count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  round(sum(cost_usd), 6) AS cost_usd, round(sum(latency_ms), 1) AS latency_ms FROM usage"""


@query(f"WITH {_USAGE} SELECT task_id, agent_id, model, {_SUMS} GROUP BY GROUPING SETS ((task_id), (task_id, agent_id), (task_id, model))")
def usage_breakdown(spark, sf_dir):
    costs = us.cost_breakdown(_usage(spark, sf_dir))
    return costs.withColumns({"cost_usd": F.round("cost_usd", 6), "latency_ms": F.round("latency_ms", 1)})


@query(f"WITH {_USAGE} SELECT task_id, {_SUMS} GROUP BY task_id")
def usage_totals(spark, sf_dir):
    totals = us.task_totals(_usage(spark, sf_dir))
    return totals.withColumns({"cost_usd": F.round("cost_usd", 6), "latency_ms": F.round("latency_ms", 1)})


@query(f"WITH {_USAGE} SELECT task_id, agent_id, {_SUMS} GROUP BY task_id, agent_id")
def agent_totals(spark, sf_dir):
    return us.agent_totals(_usage(spark, sf_dir))


@query(f"WITH {_USAGE} SELECT model, round(sum(cost_usd), 6) AS cost_usd FROM usage GROUP BY model")
def cost_by_model(spark, sf_dir):
    return us.costs_by(_usage(spark, sf_dir), "model").withColumn("cost_usd", F.round("cost_usd", 6))


def _scenario_inputs(spark, sf_dir):
    tokens = (
        _calls(spark, sf_dir)
        .groupBy("agent_id")
        .agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    )
    return tokens, small_table(spark, SCENARIOS, "scenario string, agent_id string, model string"), _prices(spark)


_SCENARIO_COSTS = f"""{_USAGE}, scenarios(scenario, agent_id, model) AS ({_values(SCENARIOS)}),
tokens AS (SELECT agent_id, sum(input_tokens) AS i, sum(output_tokens) AS o FROM calls GROUP BY agent_id),
costs AS (SELECT scenario, s.agent_id, s.model, coalesce(round(coalesce(i, 0) / 1e6 * CAST(input_price AS DOUBLE) + coalesce(o, 0) / 1e6 * CAST(output_price AS DOUBLE), 8), 0.0) AS cost_usd
  FROM scenarios s LEFT JOIN tokens USING (agent_id) LEFT JOIN prices p ON p.model = s.model)"""


@query(f"WITH {_SCENARIO_COSTS} SELECT scenario, agent_id, model, round(cost_usd, 6) AS cost_usd FROM costs")
def scenario_cost(spark, sf_dir):
    return us.scenario_costs(*_scenario_inputs(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 6))


@query(f"WITH {_SCENARIO_COSTS} SELECT scenario, round(sum(cost_usd), 6) AS estimated_cost_usd FROM costs GROUP BY scenario")
def scenario_total(spark, sf_dir):
    return us.scenario_totals(us.scenario_costs(*_scenario_inputs(spark, sf_dir)))


_STATUS = "CASE {c} WHEN 'F' THEN 'failed' WHEN 'O' THEN 'complete' ELSE 'partial' END"


@query(
    f"""WITH r AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'all_large' WHEN 1 THEN 'mixed_routing' ELSE 'all_small' END AS scenario,
  {_STATUS.format(c="o_orderstatus")} AS status, o_totalprice / (1 + o_custkey % 3) / 1e6 AS cost_usd, CAST(o_custkey AS DOUBLE) AS latency_ms FROM orders),
m AS (SELECT scenario, count(*) AS runs, count(*) FILTER (WHERE status <> 'failed') AS successful_runs,
  round(avg(cost_usd) FILTER (WHERE status <> 'failed'), 6) AS avg_cost_usd, round(avg(latency_ms), 1) AS avg_latency_ms FROM r GROUP BY scenario)
SELECT m.*, round(m.avg_cost_usd / b.avg_cost_usd, 2) AS cost_ratio, round((1 - m.avg_cost_usd / b.avg_cost_usd) * 100, 0) AS saved_percent
FROM m, (SELECT avg_cost_usd FROM m WHERE scenario = 'all_large') b"""
)
def scenario_comparison(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").selectExpr(
        "CASE o_custkey % 3 WHEN 0 THEN 'all_large' WHEN 1 THEN 'mixed_routing' ELSE 'all_small' END AS scenario",
        f"{_STATUS.format(c='o_orderstatus')} AS status",
        "o_totalprice / (1 + o_custkey % 3) / 1e6D AS cost_usd",
        "cast(o_custkey AS double) AS latency_ms",
    )
    return us.compare_scenarios(runs)


def _results(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        f"{_STATUS.format(c='o_orderstatus')} AS status",
        "o_totalprice / 500000D AS correctness_score",
        "o_custkey / 1e6D AS cost_usd",
        "cast(o_custkey % 977 AS double) AS latency_ms",
        "o_totalprice / 500000D >= 0.6D AS passed",
    )


@query(
    f"""WITH r AS (SELECT {_STATUS.format(c="o_orderstatus")} AS status, o_totalprice / 500000 AS score, o_custkey / 1e6 AS cost, CAST(o_custkey % 977 AS DOUBLE) AS ms FROM orders)
SELECT count(*) AS total_tasks, round(count(*) FILTER (WHERE status IN ('complete', 'partial')) / count(*), 4) AS completion_rate,
  round(avg(score), 4) AS avg_correctness, round(avg(cost), 6) AS avg_cost_usd, round(avg(ms), 1) AS avg_latency_ms,
  count(*) FILTER (WHERE score >= 0.6) AS passed_count, count(*) FILTER (WHERE status = 'failed') AS failed_count,
  count(*) FILTER (WHERE status = 'partial') AS partial_count FROM r"""
)
def run_summary(spark, sf_dir):
    return sc.summarise_runs(_results(spark, sf_dir))


_CLEAN = r"regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '[#*`|_\-]', ' ', 'g')"
_WORDS = rf"CAST(len(list_filter(regexp_split_to_array({_CLEAN}, '\s+'), lambda w: w <> '')) AS BIGINT)"


@query(f"SELECT doc_id, {_WORDS} AS words FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query(
    r"""WITH t AS (SELECT page_id, url || chr(10) || '## One ' || chr(10) || html || chr(10) || '## Two' AS text FROM pages),
p AS (SELECT page_id, string_split(text, chr(10) || '## ') AS parts FROM t),
e AS (SELECT page_id, unnest(range(len(parts))) AS k, parts FROM p),
s AS (SELECT page_id, k, parts[k + 1] AS part, strpos(parts[k + 1], chr(10)) AS cut FROM e)
SELECT page_id, CAST(k AS INTEGER) AS section_order,
  CASE WHEN k = 0 THEN 'Header' ELSE regexp_replace(CASE WHEN cut > 0 THEN left(part, cut - 1) ELSE part END, '^\s+|\s+$', '', 'g') END AS title,
  regexp_replace(CASE WHEN k = 0 THEN part WHEN cut > 0 THEN substr(part, cut + 1) ELSE '' END, '^\s+|\s+$', '', 'g') AS content FROM s"""
)
def sections(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.concat("url", F.lit("\n## One \n"), "html", F.lit("\n## Two")).alias("text")
    )
    return tx.sections(pages, ["page_id"], "text")


@query(
    """SELECT doc_id, array_to_string(list_filter(['The', 'eau', 'sch', 'nothing like it'], lambda s: NOT contains(lower(text), lower(s))), ',') AS missing FROM documents"""
)
def missing_sections(spark, sf_dir):
    wanted = F.array(*[F.lit(s) for s in ("The", "eau", "sch", "nothing like it")])
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(tx.missing_sections(F.col("text"), wanted), ",").alias("missing")
    )


_RESPONSES = """CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN props WHEN 2 THEN '[1, ' || props || ']' ELSE 'so: ' || props END"""


@query(
    f"""WITH r AS (SELECT event_id, event_id % 4 AS kind, props FROM events)
SELECT event_id, CASE WHEN kind < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, kind >= 2 AS rejected FROM r"""
)
def model_json_objects(spark, sf_dir):
    responses = table(spark, sf_dir, "events").selectExpr("event_id", f"{_RESPONSES.replace('chr(10)', 'char(10)')} AS content")
    return tx.parse_json_object(responses, "content").select(
        "event_id",
        F.try_variant_get("payload", "$.k", "bigint").alias("k"),
        F.col("parse_error").isNotNull().alias("rejected"),
    )


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || '|' || turn END AS items FROM conversations"""
)
def model_json_lists(spark, sf_dir):
    responses = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(
            F.col("turn") % 2 == 0,
            F.concat(F.lit('```json\n["'), "role", F.lit('", "", null, "'), F.col("turn").cast("string"), F.lit('"]\n```')),
        )
        .otherwise(F.concat(F.lit('{"role": "'), "role", F.lit('"}')))
        .alias("content"),
    )
    items = tx.parse_json_list(responses, "content")
    joined = F.when(F.size("items") > 0, F.array_join("items", "|"))
    return items.select("conv_id", "turn", joined.alias("items"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 3 THEN 'unknown' ELSE event_type END AS model,
  CASE event_id % 5 WHEN 3 THEN 0 ELSE user_id END AS input_tokens, CASE event_id % 5 WHEN 3 THEN 0 ELSE event_id + 1 END AS output_tokens FROM events"""
)
def usage_metadata(spark, sf_dir):
    """Token counts from both provider layouts, from the fallback place, and from nowhere."""
    events = table(spark, sf_dir, "events")
    name, a, b = F.col("event_type"), F.col("user_id").cast("string"), (F.col("event_id") + 1).cast("string")

    def layout(outer, model_key, usage_key, in_key, out_key):
        usage = F.concat(F.lit(f'"{usage_key}": {{"{in_key}": '), a, F.lit(f', "{out_key}": '), b, F.lit("}"))
        return F.concat(F.lit(f'{{"{outer}": {{"{model_key}": "'), name, F.lit('", '), usage, F.lit("}}"))

    kind = F.col("event_id") % 5
    raw = (
        F.when(kind == 0, layout("llm_output", "model", "usage", "input_tokens", "output_tokens"))
        .when(kind == 1, layout("llm_output", "model_id", "token_usage", "prompt_tokens", "completion_tokens"))
        .when(kind == 2, layout("generation_info", "model", "usage", "input_tokens", "output_tokens"))
        .when(kind == 3, F.lit('{"llm_output": {"usage": {}}}'))
        .otherwise(layout("llm_output", "model", "usage", "prompt_tokens", "completion_tokens"))
    )
    found = us.usage_from_metadata(events.select("event_id", raw.alias("raw")), "raw")
    return found.select("event_id", "model", "input_tokens", "output_tokens")


def _scored_runs(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    runs = documents.select(
        F.col("doc_id").alias("task_id"),
        (F.col("doc_id") % 11 != 0).alias("has_etl"),
        F.col("n_chars").alias("row_count"),
        F.array("lang", "source").alias("columns"),
        (F.col("doc_id") % 13 != 0).alias("has_analysis"),
        (F.col("doc_id") % 10 / F.lit(10.0)).alias("anomaly_rate"),
        (F.col("doc_id") % 4).alias("anomaly_count"),
        (F.col("doc_id") % 6).alias("stats_count"),
        (F.col("doc_id") % 17 != 0).alias("has_report"),
        F.col("text").alias("content"),
        tx.word_count(F.col("text")).alias("word_count"),
    )
    labels = table(spark, sf_dir, "labels")
    expectations = labels.select(
        F.col("doc_id").alias("task_id"),
        (F.col("quality") * 500).cast("bigint").alias("min_rows"),
        F.when(F.col("toxic") == 0, F.lit(4000)).cast("bigint").alias("max_rows"),
        F.array(F.lit("en"), F.lit("src3")).alias("required_columns"),
        F.lit(0.65).alias("max_anomaly_rate"),
        F.lit(2).cast("bigint").alias("min_anomaly_count"),
        F.array(F.lit("The "), F.lit("OU")).alias("required_report_sections"),
        F.lit(60).cast("bigint").alias("min_word_count"),
    )
    return runs, expectations


@query(
    f"""WITH r AS (SELECT d.doc_id, n_chars, text, lang, source, {_WORDS} AS words, l.doc_id IS NOT NULL AS expected, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT *, CASE WHEN expected THEN quality * 500 ELSE 0 END AS min_rows, CASE WHEN expected AND toxic = 0 THEN 4000 END AS max_rows,
  CASE WHEN expected THEN list_filter(['en', 'src3'], lambda x: x <> lang AND x <> source) ELSE [] END AS no_columns,
  CASE WHEN expected THEN list_filter(['The ', 'OU'], lambda x: NOT contains(lower(text), lower(x))) ELSE [] END AS no_sections,
  CASE WHEN expected THEN 0.65 ELSE 1.0 END AS max_rate, CASE WHEN expected THEN 2 ELSE 0 END AS min_anomalies, CASE WHEN expected THEN 60 ELSE 0 END AS min_words,
  length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 AS short, doc_id % 10 / 10.0 AS rate FROM r),
f AS (SELECT doc_id AS task_id, doc_id,
  CASE WHEN doc_id % 11 = 0 THEN ['ETL result missing'] ELSE [
    CASE WHEN n_chars < min_rows THEN printf('Row count %d < required %d', n_chars, min_rows) END,
    CASE WHEN n_chars > max_rows THEN printf('Row count %d > max %d', n_chars, max_rows) END,
    CASE WHEN len(no_columns) > 0 THEN 'Missing required columns: [''' || array_to_string(no_columns, ''', ''') || ''']' END] END AS fs,
  CASE WHEN doc_id % 13 = 0 THEN ['Analysis result missing'] ELSE [
    CASE WHEN rate > max_rate THEN printf('Anomaly rate %.2f%% > max %.2f%%', CAST(rate * 100 AS DOUBLE), CAST(max_rate * 100 AS DOUBLE)) END,
    CASE WHEN doc_id % 4 < min_anomalies THEN printf('Detected %d anomalies, expected >= %d', doc_id % 4, min_anomalies) END,
    CASE WHEN doc_id % 6 = 0 THEN 'No summary statistics generated' END] END AS fa,
  CASE WHEN doc_id % 17 = 0 THEN ['Report result missing'] ELSE [
    CASE WHEN len(no_sections) > 0 THEN 'Missing report sections: [''' || array_to_string(no_sections, ''', ''') || ''']' END,
    CASE WHEN words < min_words THEN printf('Report word count %d < required %d', words, min_words) END,
    CASE WHEN short THEN 'Report content appears empty or too short' END] END AS fr,
  CASE WHEN doc_id % 11 = 0 THEN 0.0 ELSE round(greatest(0.0, 1 - 0.25 * (CAST(n_chars < min_rows AS INT) + CAST(coalesce(n_chars > max_rows, false) AS INT) + len(no_columns))), 4) END AS schema_score,
  CASE WHEN doc_id % 13 = 0 THEN 0.0 ELSE round(greatest(0.0, 1 - 0.33 * (CAST(rate > max_rate AS INT) + CAST(doc_id % 4 < min_anomalies AS INT) + CAST(doc_id % 6 = 0 AS INT))), 4) END AS analysis_score,
  CASE WHEN doc_id % 17 = 0 THEN 0.0 ELSE round(greatest(0.0, 1 - 0.25 * (len(no_sections) + CAST(words < min_words AS INT) + 2 * CAST(short AS INT))), 4) END AS report_score FROM c)
SELECT task_id, CAST(schema_score AS DOUBLE) AS schema_score, CAST(analysis_score AS DOUBLE) AS analysis_score, CAST(report_score AS DOUBLE) AS report_score,
  CAST(round(schema_score * 0.30 + analysis_score * 0.40 + report_score * 0.30, 4) AS DOUBLE) AS total_score,
  round(schema_score * 0.30 + analysis_score * 0.40 + report_score * 0.30, 4) >= 0.60 AS passed,
  array_to_string(list_filter(list_concat(fs, fa, fr), lambda x: x IS NOT NULL), '; ') AS failures FROM f"""
)
def run_scores(spark, sf_dir):
    scores = sc.score_runs(*_scored_runs(spark, sf_dir))
    return scores.withColumn("failures", F.array_join("failures", "; "))


@query(
    f"""WITH {_USAGE}, r AS (SELECT o_orderkey AS task_id, strftime(o_orderdate, '%Y-%m-%d') AS stored_at, {_STATUS.format(c="o_orderstatus")} AS status FROM orders)
SELECT r.*, round(coalesce(sum(cost_usd), 0.0), 6) AS total_cost_usd FROM (SELECT * FROM r ORDER BY stored_at DESC, task_id DESC LIMIT 100) r
LEFT JOIN usage USING (task_id) GROUP BY ALL"""
)
def recent_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS task_id",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS stored_at",
        f"{_STATUS.format(c='o_orderstatus')} AS status",
    )
    return newest(runs, _usage(spark, sf_dir))


@query(
    f"""WITH {_USAGE}, u AS (SELECT task_id, sum(cost_usd) AS cost, sum(input_tokens) AS i, sum(output_tokens) AS o FROM usage GROUP BY task_id),
i AS (SELECT l_orderkey AS task_id, count(*) FILTER (WHERE l_returnflag = 'R') AS e, count(*) FILTER (WHERE l_returnflag = 'A') AS w FROM lineitem GROUP BY 1),
a AS (SELECT l_orderkey AS task_id, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1),
x AS (SELECT o_custkey AS task_id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey AS task_id, o_orderstatus AS status, o_custkey AS row_count, coalesce(e, 0) AS validation_error_count, coalesce(w, 0) AS validation_warning_count,
  coalesce(a.n, 0) AS anomaly_count, coalesce(x.n, 0) AS error_count, CAST(coalesce(i, 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(o, 0) AS BIGINT) AS total_output_tokens,
  round(coalesce(cost, 0.0), 6) AS total_cost_usd, round(CASE WHEN o_custkey = 0 THEN 0.0 ELSE coalesce(a.n, 0) / o_custkey END, 4) AS anomaly_rate
FROM orders LEFT JOIN i ON i.task_id = o_orderkey LEFT JOIN a ON a.task_id = o_orderkey LEFT JOIN x ON x.task_id = o_orderkey LEFT JOIN u ON u.task_id = o_orderkey"""
)
def run_rollup(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    runs = orders.selectExpr("o_orderkey AS task_id", "o_orderstatus AS status", "o_custkey AS row_count")
    issues = lines.selectExpr(
        "l_orderkey AS task_id", "CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity"
    )
    anomalies = lines.where("l_quantity > 48").selectExpr("l_orderkey AS task_id")
    errors = orders.where("o_orderstatus = 'F'").selectExpr("o_custkey AS task_id")
    return roll_up(runs, issues, anomalies, _usage(spark, sf_dir), errors)


def _sparse_events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "value", "nullif(event_type, 'click') AS kind", "CASE WHEN user_id % 2 = 0 THEN user_id END AS even_user"
    )


@query(
    """WITH m AS (SELECT count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM events),
z AS (SELECT event_id, value, n FROM events, m WHERE abs(value - mean) / sd > 3),
f AS (SELECT * FROM z ORDER BY event_id LIMIT 1)
SELECT 0 AS finding_order, 'Dataset contains ' || format('{:,}', n) || ' rows across 4 columns.' AS finding FROM m
UNION ALL SELECT 1, printf('%d anomalies detected (%.1f%% of rows).', count(*), count(*) * 100.0 / max(n)) FROM z
UNION ALL SELECT 2, 'Most significant anomaly at row ' || event_id || ': value = ' || CAST(value AS VARCHAR) || ' (score=-1.000).' FROM f
UNION ALL SELECT 3, 'Columns with >30% null values: even_user.' FROM events WHERE user_id % 2 = 0 HAVING count(*) < 0.7 * (SELECT n FROM m)"""
)
def findings(spark, sf_dir):
    events = _sparse_events(spark, sf_dir)
    return make_findings(compute_stats(events), zscore_records(events, ["event_id"], ["value"]), ["event_id"])


@query(
    """SELECT i AS position, c AS column_name, format('{:,}', n) AS count, printf('%.2f', mean) AS mean, printf('%.2f', sd) AS std,
  printf('%.2f', lo) AS min, printf('%.2f', med) AS median, printf('%.2f', hi) AS max FROM (
SELECT 3 AS i, 'c_acctbal' AS c, count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, min(c_acctbal) AS lo, quantile_cont(c_acctbal, 0.5) AS med, max(c_acctbal) AS hi FROM customer
UNION ALL SELECT 0, 'c_custkey', count(*), avg(c_custkey), stddev_samp(c_custkey), min(c_custkey), quantile_cont(CAST(c_custkey AS DOUBLE), 0.5), max(c_custkey) FROM customer
UNION ALL SELECT 2, 'c_nationkey', count(*), avg(c_nationkey), stddev_samp(c_nationkey), min(c_nationkey), quantile_cont(CAST(c_nationkey AS DOUBLE), 0.5), max(c_nationkey) FROM customer)"""
)
def report_numeric(spark, sf_dir):
    return rp.numeric_table(compute_stats(table(spark, sf_dir, "customer")))


@query(
    """SELECT 1 AS position, 'c_name' AS column_name, format('{:,}', count(*)) AS count, (SELECT string_agg(c_name, ', ' ORDER BY c_name) FROM (SELECT c_name FROM customer ORDER BY 1 LIMIT 3)) AS top_values FROM customer
UNION ALL SELECT 4, 'c_mktsegment', format('{:,}', count(*)), (SELECT string_agg(s, ', ' ORDER BY n DESC, s) FROM (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, s LIMIT 3)) FROM customer"""
)
def report_categorical(spark, sf_dir):
    return rp.categorical_table(compute_stats(table(spark, sf_dir, "customer")))


@query(
    """WITH m AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS nf FROM lineitem)
SELECT 0 AS severity_order, 'error' AS severity, 'nothing' AS subject, printf('Column entirely null (%d/%d rows)', n, n) AS message, n AS affected_rows FROM m
UNION ALL SELECT 1, 'warning', 'flag', printf('%.1f%% null values exceed threshold (50%%)', nf * 100.0 / n), nf FROM m WHERE nf / n > 0.5
UNION ALL SELECT 1, 'warning', 'Dataset', printf('%.1f%% duplicate rows (%d/%d)', (n - u) * 100.0 / n, n - u, n), n - u FROM m, (SELECT count(*) AS u FROM (SELECT DISTINCT nullif(l_returnflag, 'N'), l_linenumber FROM lineitem))"""
)
def report_quality(spark, sf_dir):
    sparse = table(spark, sf_dir, "lineitem").selectExpr(
        "nullif(l_returnflag, 'N') AS flag", "nullif(1, 1) AS nothing", "l_linenumber"
    )
    return rp.quality_table(validate(sparse))


@query(
    """SELECT role AS agent_id, turn AS attempt, 'LoadError: ' || CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS error, 'degraded' AS recovery_tier FROM conversations"""
)
def report_errors(spark, sf_dir):
    errors = table(spark, sf_dir, "conversations").selectExpr(
        "role AS agent_id", "turn AS attempt", "'LoadError' AS error_type", "text AS message", "'degraded' AS recovery_tier"
    )
    return rp.error_table(errors)
