"""Unusual rows and the charts that show them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from parity.registry import query, table
from plumbline.operators import charts as ch
from plumbline.operators.anomalies import DetectionSettings, anomaly_rate, detect, detect_in_order, zscore_flag
from plumbline.operators.anomalies import zscore_records as z_records
from plumbline.operators.forest import SAMPLE_ROWS, TREES, draw_samples
from plumbline.operators.profile import profile
from plumbline.operators.report import anomaly_table, meta_table, report_tables
from plumbline.operators.statistics import compute_stats
from plumbline.plans.ingest import describe
from plumbline.session import checkpoint_folder, materialize
from plumbline.sources.readers import read_file
from plumbline.sources.sinks import write_report_tables

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_Z = """m AS (SELECT avg(value) AS mean, stddev_pop(value) AS sd FROM events),
flagged AS (SELECT e.*, abs(value - mean) / sd > 3 AS is_anomaly FROM events e, m)"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(
    f"""WITH {_Z} SELECT event_id, 'value' AS column_name, value, -1.0::DOUBLE AS score, 'zscore' AS method
FROM flagged WHERE is_anomaly"""
)
def zscore_rows(spark, sf_dir):
    return z_records(_events(spark, sf_dir), ["event_id"], ["value"])


def _first_far_column(threshold: float) -> str:
    moments = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in MEASURES)
    tests = {c: f"abs({c} - {c}_m) / {c}_s > {threshold}" for c in MEASURES}
    name = " ".join(f"WHEN {t} THEN '{c}'" for c, t in tests.items())
    value = " ".join(f"WHEN {t} THEN {c}" for c, t in tests.items())
    return f"""WITH m AS (SELECT {moments} FROM lineitem)
SELECT {", ".join(LINE_KEY)}, CASE {name} END AS column_name, CASE {value} END AS value, -1.0::DOUBLE AS score, 'zscore' AS method
FROM lineitem, m WHERE {" OR ".join(tests.values())}"""


@query(_first_far_column(1.7))
def zscore_records(spark, sf_dir):
    return z_records(table(spark, sf_dir, "lineitem"), LINE_KEY, MEASURES, threshold=1.7)


@query(
    f"""WITH {_Z} SELECT count(*) FILTER (WHERE is_anomaly) AS anomaly_count, count(*) AS row_count,
  round(count(*) FILTER (WHERE is_anomaly) / count(*), 4) AS anomaly_rate FROM flagged"""
)
def anomaly_share(spark, sf_dir):
    events = _events(spark, sf_dir)
    return anomaly_rate(z_records(events, ["event_id"], ["value"]), events)


@query(_first_far_column(1.7))
def detection_by_zscore(spark, sf_dir):
    settings = DetectionSettings(use_forest=False, z_threshold=1.7)
    return detect(table(spark, sf_dir, "lineitem"), LINE_KEY, MEASURES, settings).records


@query()
def isolation_forest(spark, sf_dir):
    events = _events(spark, sf_dir)
    return detect(events, ["event_id"], ["value", "user_id"], DetectionSettings(use_z=False)).records


@query(
    """WITH planted AS (SELECT event_id FROM events ORDER BY event_id LIMIT 3)
SELECT event_id, 'isolation_forest' AS method, true AS scored_lowest, true AS in_range FROM planted"""
)
def forest_finds_planted(spark, sf_dir):
    """Three rows moved far away get lower scores than 99.9 percent of all; every score lies in [-1, 0)."""
    events = _events(spark, sf_dir).select("event_id", "value", "user_id")
    planted = events.orderBy("event_id").limit(3).select("event_id", F.lit(True).alias("planted"))
    moved = events.join(F.broadcast(planted), "event_id", "left").select(
        "event_id",
        F.when(F.col("planted"), F.lit(1e5)).otherwise(F.col("value")).alias("value"),
        F.when(F.col("planted"), F.lit(-(10**7))).otherwise(F.col("user_id")).alias("user_id"),
    )
    settings = DetectionSettings(use_z=False, contamination=0.01)
    records = materialize(detect(moved, ["event_id"], ["value", "user_id"], settings).records)
    facts = records.agg(F.percentile("score", 0.1).alias("low"), F.min("score").alias("least"), F.max("score").alias("most"))
    low, in_range = facts.select("low").scalar(), facts.select((F.col("least") >= -1) & (F.col("most") < 0)).scalar()
    return records.join(F.broadcast(planted), "event_id").select(
        "event_id", "method", (F.col("score") <= low).alias("scored_lowest"), in_range.alias("in_range")
    )


@query()
def ensemble_records(spark, sf_dir):
    return detect(_events(spark, sf_dir), ["event_id"], ["value"]).records


@query(f"WITH {_Z} SELECT event_id, is_anomaly AS by_z, true AS labels_agree FROM flagged")
def ensemble_labels(spark, sf_dir):
    """Every row: the ensemble's label says exactly which of the two methods flags it alone."""
    events = _events(spark, sf_dir)
    both = materialize(detect(events, ["event_id"], ["value", "user_id"]).records)
    forest = materialize(detect(events, ["event_id"], ["value", "user_id"], DetectionSettings(use_z=False)).records)
    joined = (
        events.select("event_id")
        .join(both.select("event_id", "method"), "event_id", "left")
        .join(forest.select("event_id", F.lit(True).alias("by_forest")), "event_id", "left")
    )
    by_z = F.coalesce(F.col("method").isin("ensemble", "zscore"), F.lit(False))
    by_forest = F.coalesce("by_forest", F.lit(False))
    label = F.when(by_z & by_forest, "ensemble").when(by_forest, "isolation_forest").when(by_z, "zscore")
    return joined.select("event_id", by_z.alias("by_z"), F.col("method").eqNullSafe(label).alias("labels_agree"))


@query(f"WITH {_Z} SELECT event_id, 'value' AS column_name, value FROM flagged WHERE is_anomaly")
def ensemble_far_rows(spark, sf_dir):
    """Of the ensemble's records, those that the z-score flags, alone or with the forest."""
    records = detect(_events(spark, sf_dir), ["event_id"], ["value", "user_id"]).records
    return records.where(F.col("method").isin("ensemble", "zscore")).select("event_id", "column_name", "value")


@query("SELECT count(*) AS row_count, true AS within_share FROM events")
def contaminated_share(spark, sf_dir):
    """The wanted share of rows, whatever their scores are; scores that tie at the limit may keep a few out."""
    settings = DetectionSettings(contamination=0.02, use_z=False)
    found = detect(_events(spark, sf_dir), ["event_id"], ["value", "user_id"], settings)
    count = F.lit(found.row_count).cast("bigint")
    return found.records.agg(F.count("*").alias("n")).select(
        count.alias("row_count"), ((F.col("n") <= 0.02 * count + 1) & (F.col("n") >= 0.015 * count - 1)).alias("within_share")
    )


@query(
    f"SELECT tree, least({SAMPLE_ROWS}, (SELECT count(*) FROM events)) AS sampled FROM range({TREES}) t(tree)"
)
def forest_samples(spark, sf_dir):
    events = _events(spark, sf_dir)
    samples = draw_samples(events, ["event_id"], ["value"], events.count(), 1.0, TREES, SAMPLE_ROWS, 42)
    return samples.groupBy(F.col("tree").cast("bigint").alias("tree")).agg(F.count("*").alias("sampled"))


@query(
    f"""WITH {_Z}, r AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS k,
  count(*) OVER () AS n FROM flagged WHERE is_anomaly)
SELECT event_id, 'value' AS column_name, CAST(value AS VARCHAR) AS value, '-1.0000' AS score, 'zscore' AS method,
  greatest(n - 20, 0) AS not_shown FROM r WHERE k <= 20"""
)
def report_anomalies(spark, sf_dir):
    return anomaly_table(z_records(_events(spark, sf_dir), ["event_id"], ["value"]), ["event_id"])


@query(f"WITH {_Z} SELECT event_id, 'value' AS column_name, value, -1.0::DOUBLE AS score, 'zscore' AS method FROM flagged WHERE is_anomaly")
def report_anomalies_all(spark, sf_dir):
    """The report set written and read back: every anomaly, not a listing's first ones."""
    events = _events(spark, sf_dir)
    records = z_records(events, ["event_id"], ["value"])
    profiled, issues = describe(events)
    tables = report_tables(profiled, issues, compute_stats(events), records, ["event_id"])
    paths = write_report_tables(tables, f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}-report", "parquet")
    return spark.read.parquet(paths["anomalies"])


@query(
    f"""WITH {_Z} SELECT count(*) FILTER (WHERE is_anomaly) AS anomaly_count, count(*) AS row_count,
  round(count(*) FILTER (WHERE is_anomaly) / count(*), 4) AS anomaly_rate FROM flagged"""
)
def report_meta(spark, sf_dir):
    events = _events(spark, sf_dir)
    records = z_records(events, ["event_id"], ["value"])
    return meta_table(profile(events.select("event_id"), samples=0), records).drop("findings")


@query(f"WITH {_Z} SELECT ts AS x, value AS y, is_anomaly FROM flagged")
def timeseries_flagged(spark, sf_dir):
    events = _events(spark, sf_dir)
    return ch.timeseries_data(events, "ts", "value", flag=zscore_flag(events, ["value"]))


@query(
    f"""WITH {_Z} SELECT date_trunc('day', ts)::TIMESTAMP AS x, round(avg(value), 4) AS y, false AS is_anomaly FROM flagged GROUP BY 1
UNION ALL SELECT ts, round(value, 4), true FROM flagged WHERE is_anomaly"""
)
def timeseries_daily(spark, sf_dir):
    events = _events(spark, sf_dir)
    records = z_records(events, ["event_id"], ["value"])
    data = ch.timeseries_data(events, "ts", "value", ["event_id"], records, bucket="day")
    return data.withColumn("y", F.round("y", 4))


@query(
    f"""WITH {_Z}, n AS (SELECT ts AS x, value AS y, epoch_us(ts) AS t FROM flagged WHERE NOT is_anomaly),
s AS (SELECT min(t) AS lo, (max(t) - min(t)) // 60 + 1 AS width FROM n), b AS (SELECT x, y, (t - lo) // width AS bucket FROM n, s),
e AS (SELECT bucket, min(x) AS first, max(x) AS last, min(y) AS low, max(y) AS high FROM b GROUP BY bucket),
c AS (SELECT bucket, first, last, low, high, min(y) FILTER (WHERE x = first) AS first_y, max(y) FILTER (WHERE x = last) AS last_y,
  min(x) FILTER (WHERE y = low) AS low_x, min(x) FILTER (WHERE y = high) AS high_x FROM b JOIN e USING (bucket) GROUP BY ALL),
p AS (SELECT bucket, first AS x, first_y AS y FROM c UNION SELECT bucket, last, last_y FROM c UNION SELECT bucket, low_x, low FROM c UNION SELECT bucket, high_x, high FROM c)
SELECT x, y, false AS is_anomaly FROM p UNION ALL SELECT ts, value, true FROM flagged WHERE is_anomaly"""
)
def timeseries_bounded(spark, sf_dir):
    """At most 240 normal points with the peaks of 60 periods, and every anomaly."""
    events = _events(spark, sf_dir)
    return ch.timeseries_bounded(events, "ts", "value", max_points=60, flag=zscore_flag(events, ["value"]))


@query(
    f"""WITH {_Z}, n AS (SELECT user_id::DOUBLE AS x, value AS y FROM flagged WHERE NOT is_anomaly),
s AS (SELECT min(x) AS x0, max(x) / 20 - min(x) / 20 AS dx, min(y) AS y0, max(y) / 20 - min(y) / 20 AS dy FROM n)
SELECT round(x0 + (i + 0.5) * dx, 6) AS x, round(y0 + (j + 0.5) * dy, 6) AS y, count(*) AS n, 'Normal' AS status
FROM (SELECT least(floor((x - x0) / dx), 19) AS i, least(floor((y - y0) / dy), 19) AS j, x0, y0, dx, dy FROM n, s) GROUP BY i, j, x0, y0, dx, dy
UNION ALL SELECT round(user_id, 6), round(value, 6), 1, 'Anomaly' FROM flagged WHERE is_anomaly"""
)
def scatter_density(spark, sf_dir):
    """Normal points counted in a grid of 20 by 20 cells, and every anomaly."""
    events = _events(spark, sf_dir)
    data = ch.scatter_grid(events, "user_id", "value", cells=20, flag=zscore_flag(events, ["value"]))
    return data.withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query(f"WITH {_Z} SELECT user_id AS x, value AS y, CASE WHEN is_anomaly THEN 'Anomaly' ELSE 'Normal' END AS status FROM flagged")
def scatter_flagged(spark, sf_dir):
    events = _events(spark, sf_dir)
    return ch.scatter_data(events, "user_id", "value", flag=zscore_flag(events, ["value"]))


@query(
    f"""WITH {_Z} SELECT user_id AS x, value AS y, CASE WHEN is_anomaly THEN 'Anomaly' ELSE 'Normal' END AS status FROM flagged
WHERE is_anomaly OR CAST('0x' || substr(md5('42|' || event_id), 1, 8) AS BIGINT) % 1000000 < 100000"""
)
def scatter_sampled(spark, sf_dir):
    events = _events(spark, sf_dir)
    records = z_records(events, ["event_id"], ["value"])
    return ch.scatter_data(events, "user_id", "value", ["event_id"], records, normal_share=0.1)


@query(f"WITH {_Z} SELECT user_id AS x, value AS y, 'Anomaly' AS status FROM flagged WHERE is_anomaly")
def scatter_sampled_anomalies(spark, sf_dir):
    """Sampling the normal rows keeps every anomaly."""
    return scatter_sampled(spark, sf_dir).where(F.col("status") == "Anomaly")


@query(
    """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events)
SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, count
FROM (SELECT CAST(least(floor((value - lo) / w), 19) AS INTEGER) AS bin, count(*) AS count FROM events, b GROUP BY 1), b"""
)
def histogram(spark, sf_dir):
    data = ch.histogram_data(_events(spark, sf_dir), "value")
    return data.withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end")})


@query("SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 15")
def bar_top15(spark, sf_dir):
    return ch.bar_data(table(spark, sf_dir, "part"), "p_brand")


@query(
    """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events)
SELECT 'timeseries' AS chart, count(*) AS points FROM events UNION ALL SELECT 'scatter', count(*) FROM events
UNION ALL SELECT 'histogram', count(DISTINCT least(floor((value - lo) / w), 19)) FROM events, b
UNION ALL SELECT 'heatmap', 4 WHERE (SELECT count(DISTINCT value) > 1 AND count(DISTINCT user_id) > 1 FROM events)"""
)
def chosen_charts(spark, sf_dir):
    events = _events(spark, sf_dir)
    records = materialize(z_records(events, ["event_id"], ["value"]))
    charts = ch.auto_charts(events, ["event_id"], records)
    sizes = [d.agg(F.lit(name).alias("chart"), F.count("*").alias("points")) for name, d in charts.items()]
    return reduce(lambda a, b: a.unionByName(b), sizes)


@query(
    f"""WITH {_Z}, placed AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM flagged)
SELECT row_index, 'value' AS column_name, value, 'zscore' AS method FROM placed WHERE is_anomaly"""
)
def records_in_row_order(spark, sf_dir):
    """Anomalies with the positions of their rows, ascending; rows are told apart by position alone."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "value")
    settings = DetectionSettings(use_forest=False)
    return detect_in_order(events, ["ts", "event_id"], ["value"], settings).records.select("row_index", "column_name", "value", "method")


@query(
    f"""WITH {_Z} SELECT event_id AS row_index, 'value' AS column_name, value, 'zscore' AS method FROM flagged WHERE is_anomaly"""
)
def records_in_file_order(spark, sf_dir):
    """The same for rows in the order of a written file (of event ids from 0)."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}-events.jsonl"
    table(spark, sf_dir, "events").select("event_id", "value").orderBy("event_id").write.json(path)
    settings = DetectionSettings(use_forest=False)
    return detect_in_order(read_file(spark, path), None, ["value"], settings).records.select("row_index", "column_name", "value", "method")
