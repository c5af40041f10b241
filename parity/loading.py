"""Loads that are cut, capped, empty or odd, small reads for the driver, and the report as one written set."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from parity.registry import query, table
from plumbline.operators import charts as ch
from plumbline.operators.anomalies import zscore_records
from plumbline.operators.findings import findings
from plumbline.operators.report import report_tables
from plumbline.operators.statistics import compute_stats
from plumbline.plans.analyse import analyse
from plumbline.plans.ingest import describe
from plumbline.session import checkpoint_folder, small_table
from plumbline.sources.readers import load_with_status, read_file
from plumbline.sources.sinks import write_report_tables
from plumbline.sources.spec import SourceSpec
from plumbline.sources.views import SqlViews


def _folder(spark, name):
    return f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}-{name}"


@query(
    """SELECT count(*) AS row_count, count(*) FILTER (WHERE o_orderkey % 10 < 2) AS corrupt_rows, count(*) FILTER (WHERE o_orderkey % 10 <> 0) AS statuses,
  max(o_custkey) AS largest FROM orders"""
)
def csv_cut_rows(spark, sf_dir):
    """Lines with a value too few are filled with nulls, those with one too many are cut; both are counted."""
    path = _folder(spark, "cut.csv")
    line = "concat_ws(',', o_orderkey, o_custkey, if(o_orderkey % 10 = 0, NULL, o_orderstatus), if(o_orderkey % 10 = 1, 'more', NULL))"
    lines = table(spark, sf_dir, "orders").selectExpr(f"{line} AS value").coalesce(1)
    spark.createDataFrame([("key,customer,status",)], "value string").coalesce(1).unionAll(lines).coalesce(1).write.text(path)
    loaded = load_with_status(spark, [SourceSpec(path, source_id="cut")])
    frame = loaded.frames["cut"].agg(F.count("status").alias("statuses"), F.max("customer").alias("largest"))
    return loaded.status.select("row_count", "corrupt_rows").join(frame)


@query("SELECT least(count(*), 250) AS capped, least(count(*), 40) AS lines FROM orders")
def row_caps(spark, sf_dir):
    """At most so many rows of a file, Parquet or text."""
    path = _folder(spark, "orders.jsonl")
    table(spark, sf_dir, "orders").select("o_orderkey").write.json(path)
    capped = read_file(spark, f"{sf_dir}/orders.parquet", row_cap=250).agg(F.count("*").alias("capped"))
    return capped.join(read_file(spark, path, row_cap=40).agg(F.count("*").alias("lines")))


@query(
    """SELECT 'empty' AS source_id, 'degraded' AS tier, CAST(0 AS BIGINT) AS row_count FROM labels HAVING count(*) > 0
UNION ALL SELECT 'gone', 'degraded', 0 FROM labels HAVING count(*) > 0 UNION ALL SELECT 'whole', 'none', count(*) FROM labels"""
)
def empty_and_missing_sources(spark, sf_dir):
    """A file without a line and a path without a file are errors of their own, beside a load that works."""
    empty, whole, labels = _folder(spark, "empty.csv"), _folder(spark, "whole.csv"), table(spark, sf_dir, "labels")
    labels.where("false").selectExpr("cast(doc_id AS string)").write.text(empty)
    labels.write.csv(whole, header=True)
    sources = {"empty": empty, "gone": f"{whole}-gone.csv", "whole": whole}
    return load_with_status(spark, [SourceSpec(p, source_id=n) for n, p in sources.items()]).status.select("source_id", "tier", "row_count")


@query(
    """SELECT o_orderstatus AS status, count(*) AS n, (SELECT count(*) FROM orders) AS row_count, (SELECT least(7, count(*)) FROM orders) AS sampled
FROM orders GROUP BY o_orderstatus"""
)
def small_reads(spark, sf_dir):
    """What a console asks of a view: a few rows as tuples, a sample, the number of rows."""
    views = SqlViews(spark)
    view = views.register(SourceSpec(f"{sf_dir}/orders.parquet", name="orders"))
    rows = views.rows("SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus")
    sizes = (views.row_count(view), views.sample(view, 7).count())
    return small_table(spark, [(*r, *sizes) for r in rows], "status string, n bigint, row_count bigint, sampled bigint")


@query(
    """SELECT 'region' AS name, CASE WHEN count(*) < 10 THEN 'degraded' ELSE 'none' END AS tier, CAST(2 AS BIGINT) AS described, CAST(0 AS BIGINT) AS records FROM region HAVING count(*) < 10
UNION ALL SELECT 'supplier', 'none', 2, (SELECT count(*) FROM supplier WHERE s_acctbal IS NULL) FROM supplier HAVING count(*) >= 10"""
)
def analysis_preconditions(spark, sf_dir):
    """Too few rows for a detection still give statistics; the outcome says so."""
    parts = []
    for name, columns in (("region", ["r_name", "r_regionkey"]), ("supplier", ["s_suppkey", "s_acctbal"])):
        done = analyse(table(spark, sf_dir, name).select(*columns), columns[:1])
        described = done.stats.agg(F.count("*").alias("described"))
        missing = done.records.where("value IS NULL").agg(F.count("*").alias("records"))
        parts.append(described.join(missing).select(F.lit(name).alias("name"), F.lit(done.tier).alias("tier"), "described", "records"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    """WITH m AS (SELECT avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events)
SELECT 'anomalies' AS name, count(*) FILTER (WHERE abs(value - mean) / sd > 3) AS n FROM events, m
UNION ALL SELECT 'schema', 3 FROM events HAVING count(*) > 0 UNION ALL SELECT 'stats', 3 FROM events HAVING count(*) > 0 UNION ALL SELECT 'meta', 1 FROM events HAVING count(*) > 0
UNION ALL SELECT 'overview', 1 FROM events HAVING count(*) > 0 UNION ALL SELECT 'chart_timeseries', count(*) FROM events
UNION ALL SELECT 'chart_histogram', count(DISTINCT least(floor((value - lo) / w), 19)) FROM events, m"""
)
def report_set(spark, sf_dir):
    """The whole report, written as JSON datasets of one folder and counted as they are read back."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    records = zscore_records(events, ["event_id"], ["value"])
    profiled, issues = describe(events)
    stats = compute_stats(events)
    charts = {"timeseries": ch.timeseries_data(events, "ts", "value"), "histogram": ch.histogram_data(events, "value")}
    tables = report_tables(profiled, issues, stats, records, ["event_id"], findings(stats, records, ["event_id"]), charts, sources=["events"])
    paths = write_report_tables(tables, _folder(spark, "report"))
    shown = ("anomalies", "schema", "stats", "meta", "overview", "chart_timeseries", "chart_histogram")
    counts = [spark.read.schema("name string").json(paths[n]).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in shown]
    return reduce(lambda a, b: a.unionByName(b), counts)
