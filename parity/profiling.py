"""Casts, profiles, checks, statistics and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity.registry import query, table
from plumbline.functions import parsing as P
from plumbline.functions.columns import col, string_columns
from plumbline.operators import casts as C
from plumbline.operators.anomalies import usable_rows
from plumbline.operators.charts import heatmap_data
from plumbline.operators.correlation import correlation_matrix
from plumbline.operators.profile import profile, profile_issues
from plumbline.operators.statistics import categorical_stats, compute_stats, numeric_stats
from plumbline.operators.validate import QualityRules, duplicate_counts, quick_validate, validate

LINEITEM_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _as_text(df):
    return df.select(*[col(c).cast("string").alias(c) for c in df.columns])


def _part_texts(spark, sf_dir):
    """Part with every column as text and some null tokens, booleans and dates mixed in."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.when(F.col("p_partkey") % 20 == 0, "N/A").otherwise(F.col("p_partkey").cast("string")).alias("key_text"),
        F.when(F.col("p_size") < 3, "x").otherwise(F.col("p_retailprice").cast("string")).alias("price_text"),
        F.when(F.col("p_size") > 25, " Yes ").otherwise("off").alias("flag_text"),
        F.concat(
            F.lit("1998-0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit("-1"), (F.col("p_size") % 10).cast("string")
        ).alias("day_text"),
        F.col("p_type").alias("kind_text"),
    )


_PART_TEXTS = """
parts AS (SELECT
  CASE WHEN p_partkey % 20 = 0 THEN 'N/A' ELSE CAST(p_partkey AS VARCHAR) END AS key_text,
  CASE WHEN p_size < 3 THEN 'x' ELSE CAST(p_retailprice AS VARCHAR) END AS price_text,
  CASE WHEN p_size > 25 THEN ' Yes ' ELSE 'off' END AS flag_text,
  '1998-0' || CAST(p_size % 9 + 1 AS VARCHAR) || '-1' || CAST(p_size % 10 AS VARCHAR) AS day_text,
  p_type AS kind_text
  FROM part)"""

_TEXT_COLUMNS = ["key_text", "price_text", "flag_text", "day_text", "kind_text"]
_WORDS = "('true','yes','1','t','y','on','false','no','0','f','n','off')"


def _rates_sql(column: str, position: int) -> str:
    return f"""SELECT {position} AS position, '{column}' AS column_name, count({column}) AS non_null,
  count(*) FILTER (WHERE regexp_matches({column}, '^\\s*-*[0-9]+\\s*$')) AS integers,
  count(*) FILTER (WHERE regexp_matches({column}, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$')) AS numbers,
  count(*) FILTER (WHERE lower(trim({column})) IN {_WORDS}) AS booleans,
  count(*) FILTER (WHERE trim({column}) = '') AS blanks,
  count(*) FILTER (WHERE try_strptime(trim({column}), '%Y-%m-%d') IS NOT NULL) AS dates
  FROM parts"""


_RATES = " UNION ALL ".join(_rates_sql(c, i) for i, c in enumerate(_TEXT_COLUMNS))


@query(f"WITH {_PART_TEXTS} {_RATES}")
def cast_rates(spark, sf_dir):
    return C.cast_rates(_part_texts(spark, sf_dir)).drop("timestamps")


@query(
    f"""WITH {_PART_TEXTS}, rates AS ({_RATES})
SELECT column_name, CASE WHEN integers >= 0.9 * non_null THEN 'Int64' WHEN numbers >= 0.9 * non_null THEN 'Float64'
  WHEN booleans > 0 AND booleans + blanks = non_null THEN 'Boolean' WHEN dates >= 0.8 * non_null THEN 'Date'
  END AS suggested_type FROM rates WHERE suggested_type IS NOT NULL"""
)
def suggest_casts(spark, sf_dir):
    return C.suggestions(C.cast_rates(_part_texts(spark, sf_dir))).drop("position")


@query(
    f"""WITH {_PART_TEXTS}
SELECT TRY_CAST(key_text AS BIGINT) AS part_key, TRY_CAST(price_text AS DOUBLE) AS price,
  trim(flag_text) = 'Yes' AS flag, strftime(TRY_CAST(day_text AS DATE), '%Y-%m-%d') AS day, kind_text
FROM parts"""
)
def apply_casts(spark, sf_dir):
    texts = _part_texts(spark, sf_dir)
    done = C.apply_casts(
        texts,
        {"key_text": "Int64", "price_text": "Float64", "flag_text": "Boolean", "day_text": "Date", "nope": "Int64"},
    )
    return done.select(
        F.col("key_text").alias("part_key"),
        F.col("price_text").alias("price"),
        F.col("flag_text").alias("flag"),
        F.date_format("day_text", "yyyy-MM-dd").alias("day"),
        "kind_text",
    )


@query(
    f"""WITH {_PART_TEXTS}, cleaned AS (SELECT
  CASE WHEN key_text NOT IN ('','NULL','null','N/A','n/a','NA','na','None','none','-') THEN key_text END AS k, kind_text FROM parts)
SELECT kind_text, count(*) AS n, count(k) AS present, count(*) - count(k) AS missing FROM cleaned GROUP BY kind_text"""
)
def null_tokens(spark, sf_dir):
    texts = _part_texts(spark, sf_dir)
    cleaned = texts.select(P.blank_to_null(F.col("key_text")).alias("k"), "kind_text")
    return cleaned.groupBy("kind_text").agg(
        F.count("*").alias("n"), F.count("k").alias("present"), (F.count("*") - F.count("k")).alias("missing")
    )


@query(
    """SELECT count(*) AS all_rows, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS complete_rows,
  count(*) FILTER (WHERE a IS NOT NULL OR b IS NOT NULL) AS scored_rows,
  CAST(sum(coalesce(a, 0) + coalesce(b, 0)) AS BIGINT) AS zero_filled_sum
FROM (SELECT nullif(l_linenumber, 3) AS a, nullif(CAST(l_quantity AS BIGINT), 10) AS b FROM lineitem)"""
)
def null_policies(spark, sf_dir):
    sparse = table(spark, sf_dir, "lineitem").selectExpr(
        "nullif(l_linenumber, 3) AS a", "nullif(cast(l_quantity AS bigint), 10) AS b"
    )
    whole, complete = usable_rows(sparse, ["a", "b"])
    filled, any_value = usable_rows(sparse, ["a", "b"], fill_gaps=True)
    counts = whole.agg(F.count("*").alias("all_rows"), F.count_if(complete).alias("complete_rows"))
    return filled.agg(
        F.count_if(any_value).alias("scored_rows"), F.sum(F.col("a") + F.col("b")).cast("bigint").alias("zero_filled_sum")
    ).select(*[counts.select(c).scalar().alias(c) for c in counts.columns], "scored_rows", "zero_filled_sum")


_LINEITEM_COLUMNS = {
    **dict.fromkeys(["l_orderkey", "l_partkey", "l_suppkey"], "bigint"),
    "l_linenumber": "int",
    **dict.fromkeys(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "double"),
    **dict.fromkeys(["l_returnflag", "l_linestatus"], "string"),
    "l_shipdate": "timestamp_ntz",
}


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    parts = []
    for i, (column, kind) in enumerate(columns.items()):
        text = f"strftime({column}, '%Y-%m-%d %H:%M:%S')" if kind == "timestamp_ntz" else f"CAST({column} AS VARCHAR)"
        parts.append(
            f"""SELECT {i} AS position, '{column}' AS column_name, '{kind}' AS dtype,
  count(*) > count({column}) AS nullable, count(*) AS row_count, count(*) - count({column}) AS null_count,
  round((count(*) - count({column})) / count(*), 4) AS null_rate,
  count(DISTINCT {column}) + CAST(count(*) > count({column}) AS INTEGER) AS unique_count,
  (SELECT string_agg(s, '|' ORDER BY v) FROM (SELECT DISTINCT {column} AS v, {text} AS s FROM {name}
    WHERE {column} IS NOT NULL ORDER BY v LIMIT 5)) AS samples FROM {name}"""
        )
    return " UNION ALL ".join(parts)


def _shown(profiled):
    return profiled.drop("is_approx", "number_share").withColumn("samples", F.array_join("samples", "|"))


@query(
    _profile_sql(
        "orders",
        {
            "o_orderkey": "bigint",
            "o_custkey": "bigint",
            "o_orderstatus": "string",
            "o_totalprice": "double",
            "o_orderdate": "timestamp_ntz",
            "o_orderpriority": "string",
        },
    )
)
def schema_profile(spark, sf_dir):
    return _shown(profile(table(spark, sf_dir, "orders"), distinct="exact"))


@query(
    "WITH sparse AS (SELECT p_partkey, nullif(p_type, 'PROMO') AS p_type, nullif(p_size, 7) AS p_size FROM part) "
    + _profile_sql("sparse", {"p_partkey": "bigint", "p_type": "string", "p_size": "int"})
)
def schema_profile_nulls(spark, sf_dir):
    sparse = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "nullif(p_type, 'PROMO') AS p_type", "nullif(p_size, 7) AS p_size"
    )
    return _shown(profile(sparse, distinct="exact"))


@query(f"SELECT * EXCLUDE (unique_count) FROM ({_profile_sql('lineitem', _LINEITEM_COLUMNS)})")
def schema_profile_sketched(spark, sf_dir):
    """All but the sketched counts, which ``sketched_distinct_counts`` holds against exact ones."""
    return _shown(profile(table(spark, sf_dir, "lineitem"), distinct="approx")).drop("unique_count")


@query(
    """SELECT 'key_text' AS column_name, count(*) AS row_count, count(DISTINCT o_orderkey) AS unique_count,
  count(*) > 10 AND count(DISTINCT o_orderkey) > 0.95 * count(*) AS is_likely_id FROM orders"""
)
def profile_ids(spark, sf_dir):
    """A unique text column is exact and warned of by default, whatever the table's size."""
    keys = profile(table(spark, sf_dir, "orders").selectExpr("concat('k', o_orderkey) AS key_text"))
    warned = profile_issues(keys).where(F.col("message").contains("likely an ID")).agg(F.count("*") > 0)
    return keys.select("column_name", "row_count", "unique_count", warned.scalar().alias("is_likely_id"))


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, 0.0::DOUBLE AS null_rate, true AS is_approx, true AS is_close FROM lineitem"""
        for c in _LINEITEM_COLUMNS
    )
)
def sketched_distinct_counts(spark, sf_dir):
    """Sketched distinct counts next to exact ones: within 15 percent, three times the sketch's deviation."""
    lines = table(spark, sf_dir, "lineitem")
    exact = profile(lines, distinct="exact", samples=0).select("column_name", F.col("unique_count").alias("exact"))
    sketched = profile(lines, distinct="approx", samples=0).join(exact, "column_name")
    close = F.abs(F.col("unique_count") - F.col("exact")) <= 0.15 * F.col("exact")
    return sketched.select("column_name", "row_count", "null_rate", "is_approx", close.alias("is_close"))


@query(
    """WITH d AS (SELECT c_name, CAST(c_custkey AS VARCHAR) AS key_text,
  CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS balance, nullif(1, 1) AS nothing FROM customer),
m AS (SELECT count(*) AS n, count(DISTINCT c_name) AS u1, count(DISTINCT key_text) AS u2,
  count(*) - count(balance) AS nb FROM d)
SELECT 'c_name' AS column_name, 'warning' AS severity, printf('High-cardinality column (%.0f%% unique) — likely an ID, may not be useful for analysis', u1 * 100.0 / n) AS message, CAST(0 AS BIGINT) AS affected_rows FROM m WHERE n > 10 AND u1 / n > 0.95
UNION ALL SELECT 'key_text', 'warning', 'Column ''key_text'' is String but values appear numeric — consider casting', 0 FROM m
UNION ALL SELECT 'key_text', 'warning', printf('High-cardinality column (%.0f%% unique) — likely an ID, may not be useful for analysis', u2 * 100.0 / n), 0 FROM m WHERE n > 10 AND u2 / n > 0.95
UNION ALL SELECT 'balance', 'warning', printf('%.0f%% null values (%d/%d rows)', nb * 100.0 / n, nb, n), nb FROM m WHERE nb / n > 0.5
UNION ALL SELECT 'nothing', 'warning', printf('100%% null values (%d/%d rows)', n, n), n FROM m
UNION ALL SELECT 'nothing', 'error', 'Column ''nothing'' is entirely null', n FROM m"""
)
def profile_findings(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").selectExpr(
        "c_name",
        "cast(c_custkey AS string) AS key_text",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS balance",
        "nullif(1, 1) AS nothing",
    )
    return profile_issues(profile(customer, distinct="exact")).drop("position")


_SHOWN_ISSUE = ["check_name", "column_name", "severity", "message", "affected_rows"]


@query(
    """SELECT 'structure' AS check_name, CAST(NULL AS VARCHAR) AS column_name, 'warning' AS severity,
  printf('Only %d rows — expected at least 10000000', count(*)) AS message, count(*) AS affected_rows FROM lineitem"""
)
def structure_check(spark, sf_dir):
    rules = QualityRules(min_rows=10_000_000)
    return validate(table(spark, sf_dir, "lineitem"), rules, ["structure"]).select(*_SHOWN_ISSUE)


@query(
    """WITH d AS (SELECT nullif(l_returnflag, 'N') AS flag, CASE WHEN l_quantity > 45 THEN l_tax END AS tax,
  nullif(1, 1) AS nothing, l_orderkey FROM lineitem),
m AS (SELECT count(*) AS n, count(*) - count(flag) AS nf, count(*) - count(tax) AS nt FROM d)
SELECT 'nulls' AS check_name, 'flag' AS column_name, 'warning' AS severity,
  printf('%.1f%% null values exceed threshold (20%%)', nf * 100.0 / n) AS message, nf AS affected_rows FROM m WHERE nf / n > 0.2
UNION ALL SELECT 'nulls', 'tax', 'warning', printf('%.1f%% null values exceed threshold (50%%)', nt * 100.0 / n), nt FROM m WHERE nt / n > 0.5
UNION ALL SELECT 'nulls', 'nothing', 'error', printf('Column entirely null (%d/%d rows)', n, n), n FROM m"""
)
def null_checks(spark, sf_dir):
    sparse = table(spark, sf_dir, "lineitem").selectExpr(
        "nullif(l_returnflag, 'N') AS flag",
        "CASE WHEN l_quantity > 45 THEN l_tax END AS tax",
        "nullif(1, 1) AS nothing",
        "l_orderkey",
    )
    return validate(sparse, QualityRules(null_thresholds={"flag": 0.2}), ["nulls"]).select(*_SHOWN_ISSUE)


@query(
    """WITH m AS (SELECT count(*) FILTER (WHERE l_quantity < 5) AS qb, count(*) FILTER (WHERE l_quantity > 45.5) AS qa,
  count(*) FILTER (WHERE l_discount > 0.08) AS da FROM lineitem)
SELECT 'numeric_ranges' AS check_name, 'l_quantity' AS column_name, 'warning' AS severity,
  printf('%d values below expected minimum (5)', qb) AS message, qb AS affected_rows FROM m WHERE qb > 0
UNION ALL SELECT 'numeric_ranges', 'l_quantity', 'warning', printf('%d values above expected maximum (45.5)', qa), qa FROM m WHERE qa > 0
UNION ALL SELECT 'numeric_ranges', 'l_discount', 'warning', printf('%d values above expected maximum (0.08)', da), da FROM m WHERE da > 0"""
)
def range_checks(spark, sf_dir):
    rules = QualityRules(
        numeric_ranges={"l_quantity": (5, 45.5), "l_discount": (0.0, 0.08), "l_returnflag": (0, 1), "gone": (0, 1)}
    )
    return validate(table(spark, sf_dir, "lineitem"), rules, ["numeric_ranges"]).select(*_SHOWN_ISSUE)


@query(
    """WITH d AS (SELECT l_suppkey, l_quantity FROM lineitem),
m AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS u)
SELECT 'duplicates' AS check_name, CAST(NULL AS VARCHAR) AS column_name, 'warning' AS severity,
  printf('%.1f%% duplicate rows (%d/%d)', (n - u) * 100.0 / n, n - u, n) AS message, n - u AS affected_rows FROM m
WHERE (n - u) / n > 0.1"""
)
def duplicate_check(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    return validate(pairs, checks=["duplicates"]).select(*_SHOWN_ISSUE)


@query(
    """SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS distinct_rows FROM lineitem"""
)
def duplicate_rows(spark, sf_dir):
    return duplicate_counts(table(spark, sf_dir, "lineitem")).withColumnRenamed("rows", "row_count")


@query(
    """SELECT 'required_columns' AS check_name, 'o_comment' AS column_name, 'error' AS severity,
  'Required column ''o_comment'' is missing from DataFrame' AS message, CAST(0 AS BIGINT) AS affected_rows WHERE EXISTS (SELECT 1 FROM orders)
UNION ALL SELECT 'expected_types', 'o_custkey', 'warning', 'Expected dtype ''Utf8'', got ''bigint''', 0 WHERE EXISTS (SELECT 1 FROM orders)"""
)
def required_and_type_checks(spark, sf_dir):
    rules = QualityRules(
        required_columns=["o_orderkey", "o_comment"],
        expected_types={"o_orderkey": "Int64", "o_custkey": "Utf8", "o_totalprice": "FLOAT64", "o_gone": "Int64"},
    )
    orders = table(spark, sf_dir, "orders")
    return validate(orders, rules, ["structure", "required_columns", "expected_types"]).select(*_SHOWN_ISSUE)


@query(
    """WITH d AS (SELECT p_type, p_size % 3 AS third, nullif(1, 1) AS nothing FROM part),
m AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS u FROM d)
SELECT 'nulls' AS check_name, 'nothing' AS column_name, 'error' AS severity,
  printf('Column entirely null (%d/%d rows)', n, n) AS message, n AS affected_rows FROM m
UNION ALL SELECT 'required_columns', 'price', 'error', 'Required column ''price'' is missing from DataFrame', 0 FROM m
UNION ALL SELECT 'duplicates', NULL, 'warning', printf('%.1f%% duplicate rows (%d/%d)', (n - u) * 100.0 / n, n - u, n), n - u FROM m WHERE (n - u) / n > 0.1"""
)
def quick_validation(spark, sf_dir):
    sparse = table(spark, sf_dir, "part").selectExpr("p_type", "p_size % 3 AS third", "nullif(1, 1) AS nothing")
    return quick_validate(sparse, ["p_type", "price"]).select(*_SHOWN_ISSUE)


def _numeric_sql(name: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{kind}' AS dtype, count({c}) AS count, count(*) - count({c}) AS null_count,
  round(avg({c}), 4) AS mean, round(CASE WHEN count({c}) = 1 THEN 0.0 ELSE stddev_samp({c}) END, 4) AS std,
  round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75 FROM {name}"""
        for c, kind in columns.items()
    )


def _rounded(stats):
    measures = [m for m in ("mean", "std", "min", "max", "p25", "p50", "p75")]
    return stats.drop("position").withColumns({m: F.round(m, 4) for m in measures})


_LINEITEM_TYPES = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    **{c: "double" for c in LINEITEM_MEASURES},
}


@query(_numeric_sql("lineitem", _LINEITEM_TYPES))
def numeric_stats_lineitem(spark, sf_dir):
    return _rounded(numeric_stats(table(spark, sf_dir, "lineitem")))


@query(_numeric_sql("events", {"event_id": "bigint", "user_id": "bigint", "value": "double"}))
def numeric_stats_events(spark, sf_dir):
    return _rounded(numeric_stats(table(spark, sf_dir, "events")))


@query(_numeric_sql("lineitem", {c: "double" for c in LINEITEM_MEASURES}))
def numeric_stats_narrowed(spark, sf_dir):
    """The same with few buckets, so that it takes many passes, as huge columns would."""
    measures = table(spark, sf_dir, "lineitem").select(*LINEITEM_MEASURES)
    return _rounded(numeric_stats(measures, buckets=4))


@query(
    """WITH d AS (SELECT nullif(l_quantity, 10) AS quantity, CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS price,
  nullif(l_linenumber, l_linenumber) AS nothing FROM lineitem) """
    + _numeric_sql("d", {"quantity": "double", "price": "double", "nothing": "int"})
)
def numeric_stats_nulls(spark, sf_dir):
    sparse = table(spark, sf_dir, "lineitem").selectExpr(
        "nullif(l_quantity, 10) AS quantity",
        "CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS price",
        "nullif(l_linenumber, l_linenumber) AS nothing",
    )
    return _rounded(numeric_stats(sparse))


@query(
    """WITH d AS (SELECT event_type, props, nullif(event_type, 'click') AS sparse FROM events),
c AS (SELECT 'event_type' AS column_name, event_type AS v, count(*) AS n FROM d GROUP BY v
  UNION ALL SELECT 'props', props, count(*) FROM d GROUP BY props
  UNION ALL SELECT 'sparse', sparse, count(*) FROM d GROUP BY sparse),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS k FROM c WHERE v IS NOT NULL)
SELECT column_name, 'string' AS dtype, CAST((SELECT sum(n) FROM c WHERE c.column_name = r.column_name AND v IS NOT NULL) AS BIGINT) AS count,
  CAST(coalesce((SELECT sum(n) FROM c WHERE c.column_name = r.column_name AND v IS NULL), 0) AS BIGINT) AS null_count,
  string_agg(v, '|' ORDER BY k) AS top_values FROM r WHERE k <= 5 GROUP BY column_name"""
)
def categorical_top5(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("event_type", "props", "nullif(event_type, 'click') AS sparse")
    return categorical_stats(events).drop("position").withColumn("top_values", F.array_join("top_values", "|"))


@query(
    """SELECT 0 AS position, 'c_custkey' AS column_name, count(*) AS count, round(avg(c_custkey), 4) AS mean, '' AS top_values FROM customer
UNION ALL SELECT 1, 'c_name', count(*), NULL, (SELECT string_agg(c_name, '|' ORDER BY c_name) FROM (SELECT c_name FROM customer ORDER BY c_name LIMIT 5)) FROM customer
UNION ALL SELECT 2, 'c_nationkey', count(*), round(avg(c_nationkey), 4), '' FROM customer
UNION ALL SELECT 3, 'c_acctbal', count(*), round(avg(c_acctbal), 4), '' FROM customer
UNION ALL SELECT 4, 'c_mktsegment', count(*), NULL, (SELECT string_agg(s, '|' ORDER BY n DESC, s) FROM (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY s)) FROM customer"""
)
def all_column_stats(spark, sf_dir):
    stats = compute_stats(table(spark, sf_dir, "customer"))
    return stats.select(
        "position",
        "column_name",
        "count",
        F.round("mean", 4).alias("mean"),
        F.array_join("top_values", "|").alias("top_values"),
    )


def _correlation_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(coalesce(corr({a}, {b}), 0.0), 4) + 0.0 AS correlation FROM {name}"
        for a in columns
        for b in columns
    )


@query(_correlation_sql("lineitem", LINEITEM_MEASURES))
def correlation(spark, sf_dir):
    return correlation_matrix(table(spark, sf_dir, "lineitem"), LINEITEM_MEASURES).withColumn(
        "correlation", F.col("correlation") + F.lit(0.0)
    )


@query(
    "WITH d AS (SELECT l_quantity + l_linenumber * 4 AS a, nullif(l_linenumber, 3) AS b, CASE WHEN l_tax > 0.02 THEN l_quantity END AS c FROM lineitem) "
    + _correlation_sql("d", ["a", "b", "c"])
)
def correlation_nulls(spark, sf_dir):
    sparse = table(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity + l_linenumber * 4 AS a",
        "nullif(l_linenumber, 3) AS b",
        "CASE WHEN l_tax > 0.02 THEN l_quantity END AS c",
    )
    return heatmap_data(sparse).withColumn("correlation", F.col("correlation") + F.lit(0.0))


@query(
    """SELECT column_name, suggested_type FROM (VALUES ('o_orderkey', 'Int64'), ('o_custkey', 'Int64'), ('o_totalprice', 'Float64'))
t(column_name, suggested_type) WHERE (SELECT count(*) FROM orders) > 0"""
)
def suggest_casts_orders(spark, sf_dir):
    texts = _as_text(table(spark, sf_dir, "orders"))
    assert string_columns(texts) == texts.columns
    return C.suggestions(C.cast_rates(texts)).drop("position")
