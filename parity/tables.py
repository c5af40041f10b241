"""Loading, SQL, merging, references and row numbers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from parity.registry import query, table
from plumbline.operators import merge as mg
from plumbline.operators.asof import asof_join
from plumbline.operators.counts import with_remainder
from plumbline.operators.keys import with_row_index
from plumbline.plans.ingest import ingest
from plumbline.session import checkpoint_folder
from plumbline.sources.encoding import detect_encodings
from plumbline.sources.readers import load_with_status, read_file
from plumbline.sources.sinks import write_report_tables, write_rows
from plumbline.sources.spec import SourceSpec
from plumbline.sources.views import SqlViews


def _folder(spark, name):
    return f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}-{name}"


_written: dict[tuple, str] = {}


def _fixture(spark, sf_dir, name, write):
    """A text copy of a table, written once per session, so that repeated runs time the load alone."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = _folder(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def _views(spark, sf_dir, *names):
    views = SqlViews(spark)
    for name in names:
        views.register(SourceSpec(f"{sf_dir}/{name}.parquet", name=name))
    return views


_SUMMARY = """SELECT o_orderstatus, count(*) AS n, count(priority) AS priorities, count(total) AS totals,
  round(sum(total), 2) AS total, min(day) AS first_day FROM (
  SELECT o_orderstatus, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority,
    CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END AS total, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
GROUP BY o_orderstatus"""


def _orders_with_tokens(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderpriority") == "5-LOW", "N/A").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_custkey") % 7 == 0, "NULL").otherwise(F.col("o_totalprice").cast("string")).alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )


def _summary(df):
    assert dict(df.dtypes) == {
        "o_orderkey": "bigint", "o_orderstatus": "string", "priority": "string", "total": "double", "day": "date"
    }
    return df.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"),
        F.count("priority").alias("priorities"),
        F.count("total").alias("totals"),
        F.round(F.sum("total"), 2).alias("total"),
        F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"),
    )


@query(_SUMMARY)
def csv_load(spark, sf_dir):
    orders = _orders_with_tokens(spark, sf_dir)
    return _summary(read_file(spark, _fixture(spark, sf_dir, "orders.csv", lambda p: orders.write.csv(p, header=True))))


@query(_SUMMARY)
def tsv_load(spark, sf_dir):
    orders = _orders_with_tokens(spark, sf_dir)
    path = _fixture(spark, sf_dir, "orders.tsv", lambda p: orders.write.csv(p, header=True, sep="\t"))
    return _summary(read_file(spark, path))


@query("SELECT doc_id, lang, source, n_chars, text FROM documents")
def json_lines_load(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    path = _fixture(spark, sf_dir, "documents.jsonl", lambda p: write_rows(documents, p, "json"))
    return read_file(spark, path).select("doc_id", "lang", "source", "n_chars", "text")


@query("SELECT vec_id, label, len(embedding) AS dimensions, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 3) AS norm FROM embeddings")
def parquet_load(spark, sf_dir):
    vectors = read_file(spark, f"{sf_dir}/embeddings.parquet")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return vectors.select("vec_id", "label", F.size("embedding").cast("bigint").alias("dimensions"), F.round(norm, 3).alias("norm"))


@query(
    """SELECT 'customer' AS source_id, 'none' AS tier, count(*) AS row_count, CAST(0 AS BIGINT) AS corrupt_rows, false AS warned FROM customer
UNION ALL SELECT 'pages', 'none', count(*), 0, false FROM pages
UNION ALL SELECT 'missing', 'degraded', 0, 0, true"""
)
def load_status(spark, sf_dir):
    sources = [SourceSpec(f"{sf_dir}/{n}.parquet", source_id=n) for n in ("customer", "pages", "missing")]
    status = load_with_status(spark, sources).status
    return status.select("source_id", "tier", "row_count", "corrupt_rows", F.col("warning").isNotNull().alias("warned"))


@query("SELECT 'utf-8' AS encoding, count(*) AS documents FROM documents")
def encodings(spark, sf_dir):
    path = _folder(spark, "texts")
    table(spark, sf_dir, "documents").select("text").write.option("lineSep", "\u0000").text(path)
    texts = spark.read.option("lineSep", "\u0000").text(path).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("n"))
    found = detect_encodings(texts).join(texts, "path")
    return found.groupBy("encoding").agg(F.sum("n").alias("documents"))


@query(
    """SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang
UNION ALL SELECT source, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY source"""
)
def written_tables(spark, sf_dir):
    """Several result tables written as one set and read back."""
    documents = table(spark, sf_dir, "documents")

    def totals(column):
        return documents.groupBy(F.col(column).alias("lang")).agg(
            F.count("*").alias("documents"), F.sum("n_chars").alias("chars")
        )

    tables = {"by_lang": totals("lang"), "by_source": totals("source")}
    paths = write_report_tables(tables, _folder(spark, "report"), "parquet")
    return reduce(lambda a, b: a.unionByName(b), [spark.read.parquet(p) for p in paths.values()])


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'")
def sql_sum(spark, sf_dir):
    return _views(spark, sf_dir, "lineitem").query(
        "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines "
        "FROM lineitem WHERE l_shipdate < TIMESTAMP_NTZ '1999-01-01'"
    )


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 150")
def sql_filter(spark, sf_dir):
    return _views(spark, sf_dir, "events").query(
        "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 150", row_cap=None
    )


@query(
    """SELECT c_mktsegment, count(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
GROUP BY c_mktsegment"""
)
def sql_semi_join(spark, sf_dir):
    return _views(spark, sf_dir, "customer", "orders").query(
        "SELECT c_mktsegment, count(*) AS customers FROM customer LEFT SEMI JOIN "
        "(SELECT o_custkey FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey GROUP BY c_mktsegment"
    )


@query(
    """SELECT n_name, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderstatus)"""
)
def sql_rollup(spark, sf_dir):
    return _views(spark, sf_dir, "orders", "customer", "nation").query(
        "SELECT n_name, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders "
        "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
        "GROUP BY ROLLUP (n_name, o_orderstatus)"
    )


@query(
    """SELECT user_id, event_id, row_number() OVER w AS visit, round(value - lag(value) OVER w, 4) AS change FROM events
WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)"""
)
def sql_window(spark, sf_dir):
    """Visits of a user within a day: a busy user is split by day."""
    return _views(spark, sf_dir, "events").query(
        "SELECT user_id, event_id, CAST(row_number() OVER w AS bigint) AS visit, round(value - lag(value) OVER w, 4) AS change "
        "FROM events WINDOW w AS (PARTITION BY user_id, to_date(ts) ORDER BY ts, event_id)",
        row_cap=None,
    )


@query(
    """(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"""
)
def sql_set_operations(spark, sf_dir):
    return _views(spark, sf_dir, "orders", "customer").query(
        "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT "
        "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT "
        "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
        row_cap=None,
    )


@query(
    """SELECT p_type, p_size, count(*) AS parts, count(*) FILTER (WHERE p_retailprice > 1000) AS dear, grouping(p_type) AS g FROM part
GROUP BY CUBE (p_type, p_size)"""
)
def sql_cube_filter(spark, sf_dir):
    return _views(spark, sf_dir, "part").query(
        "SELECT p_type, p_size, count(*) AS parts, count(*) FILTER (WHERE p_retailprice > 1000) AS dear, "
        "CAST(grouping(p_type) AS bigint) AS g FROM part GROUP BY CUBE (p_type, p_size)"
    )


@query(
    """SELECT e.event_id, p.event_id AS purchase_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error'"""
)
def sql_latest_before(spark, sf_dir):
    """The latest purchase before each error of the same user, by the as-of join over two SQL views."""
    views = _views(spark, sf_dir, "events")
    errors = views.query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'", row_cap=None)
    purchases = views.query("SELECT user_id, ts, event_id AS purchase_id FROM events WHERE event_type = 'purchase'", row_cap=None)
    return asof_join(errors, purchases, ["user_id"], "ts", ["purchase_id"]).select("event_id", "purchase_id")


@query("SELECT count(*) AS lines, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem")
def sql_uncapped(spark, sf_dir):
    """Without a cap of the caller a query has all its rows."""
    lines = _views(spark, sf_dir, "lineitem").query("SELECT l_orderkey FROM lineitem")
    return lines.agg(F.count("*").alias("lines"), F.sum("l_orderkey").alias("keys"))


_BIG = "concat('1234567890123456', lpad(o_orderkey, 6, '0'))"


@query("SELECT 'string' AS kind, count(*) AS n, min('1234567890123456' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0')) AS first_value FROM orders")
def csv_big_integers(spark, sf_dir):
    """Integers beyond 64 bits stay text where a double would round them."""
    path = _folder(spark, "big.csv")
    table(spark, sf_dir, "orders").selectExpr(f"{_BIG} AS big", "o_orderkey").write.csv(path, header=True)
    df = read_file(spark, path)
    return df.agg(F.lit(dict(df.dtypes)["big"]).alias("kind"), F.count("big").alias("n"), F.min("big").alias("first_value"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def csv_quoted_breaks(spark, sf_dir):
    """Texts with line breaks come back whole."""
    path = _folder(spark, "texts.csv")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.csv(path, header=True, escape='"', quoteAll=True)
    df = read_file(spark, path)
    return df.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.sum(F.length("text")).alias("chars"))


def _status(spark, **paths):
    status = load_with_status(spark, [SourceSpec(p, source_id=n) for n, p in paths.items()]).status
    return status.select("source_id", "tier", "row_count", F.col("warning").isNotNull().alias("warned"))


@query("SELECT 'mixed' AS source_id, 'degraded' AS tier, CAST(count(*) * 0 AS BIGINT) AS row_count, count(*) > 0 AS warned FROM orders")
def csv_mixed_headers(spark, sf_dir):
    """Files of a folder with their columns in another order are refused, not shuffled."""
    path, orders = _folder(spark, "mixed.csv"), table(spark, sf_dir, "orders")
    orders.select("o_orderkey", "o_orderstatus").write.csv(path, header=True)
    orders.select("o_orderstatus", "o_orderkey").write.csv(path, header=True, mode="append")
    return _status(spark, mixed=path)


@query(
    """SELECT 'broken' AS source_id, 'degraded' AS tier, CAST(0 AS BIGINT) AS row_count, count(*) > 0 AS warned FROM labels
UNION ALL SELECT 'whole', 'none', count(*), false FROM labels"""
)
def json_broken(spark, sf_dir):
    """Lines that are no JSON make a load fail instead of becoming rows of nulls."""
    broken, whole, labels = _folder(spark, "broken.jsonl"), _folder(spark, "whole.jsonl"), table(spark, sf_dir, "labels")
    labels.write.json(whole)
    labels.selectExpr("if(doc_id % 2 = 0, to_json(struct(*)), concat('{', doc_id)) AS value").write.text(broken)
    return _status(spark, broken=broken, whole=whole)


@query("SELECT s_suppkey, s_name, n_name FROM supplier s FULL JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey DESC) AS k FROM nation) n ON k = (SELECT count(*) FROM supplier x WHERE x.s_acctbal < s.s_acctbal OR (x.s_acctbal = s.s_acctbal AND x.s_suppkey < s.s_suppkey)) + 1")
def merge_by_orders(spark, sf_dir):
    """Tables with other columns side by side, each in the order stated for it."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    nation = table(spark, sf_dir, "nation").selectExpr("n_name", "-n_nationkey AS down")
    merged = mg.merge([supplier, nation], [["s_acctbal", "s_suppkey"], ["down"]])
    return merged.select("s_suppkey", "s_name", "n_name")


@query(
    """SELECT 'n_nationkey' AS column_name, 'bigint' AS dtype, 2 * count(*) AS row_count, count(DISTINCT n_nationkey) AS unique_count FROM nation
UNION ALL SELECT 'n_name', 'string', 2 * count(*), count(DISTINCT n_name) FROM nation"""
)
def ingest_two_sources(spark, sf_dir):
    """Two sources stacked, types mended, described."""
    one, other = _folder(spark, "one.csv"), _folder(spark, "other.jsonl")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nation.write.csv(one, header=True)
    nation.select("n_name", "n_nationkey").write.json(other)
    got = ingest(spark, [SourceSpec(one, source_id="one"), SourceSpec(other, source_id="other")])
    return got.profile.select("column_name", "dtype", "row_count", "unique_count")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def sql_row_cap(spark, sf_dir):
    return _views(spark, sf_dir, "orders").query(
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", row_cap=1000
    )


@query(
    """SELECT 'supplier' AS view_name, count(*) AS row_count, 's_suppkey,s_name,s_nationkey,s_acctbal' AS columns FROM supplier
UNION ALL SELECT 'labels', count(*), 'doc_id,quality,toxic' FROM labels"""
)
def view_catalog(spark, sf_dir):
    views = _views(spark, sf_dir, "supplier", "labels")
    parts = [
        views.query(f"SELECT '{v}' AS view_name, count(*) AS row_count, '{','.join(views.column_names(v))}' AS columns FROM {v}")
        for v in views.views()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"""
)
def merge_vertical(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance"
    )
    supplier = table(spark, sf_dir, "supplier").selectExpr(
        "s_acctbal AS balance", "s_suppkey AS id", "s_name AS name", "s_nationkey AS nation"
    )
    return mg.merge([customer, supplier])


@query(
    """WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, c_custkey, c_acctbal AS balance FROM customer),
s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_index, s_suppkey, s_acctbal AS balance_1 FROM supplier)
SELECT row_index, c_custkey, balance, s_suppkey, balance_1 FROM c FULL JOIN s USING (row_index)"""
)
def merge_horizontal(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal AS balance")
    supplier = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_acctbal AS balance")
    return mg.side_by_side([customer, supplier], [["c_custkey"], ["s_suppkey"]])


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders"""
)
def row_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return with_row_index(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_index")


@query(
    """SELECT l_returnflag, count(*) AS n, min(row_index) AS first_row, max(row_index) AS last_row, count(DISTINCT row_index) AS places
FROM (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS row_index FROM lineitem) GROUP BY l_returnflag"""
)
def row_index_with_ties(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag")
    return (
        with_row_index(lines, ["l_returnflag"], unique=False)
        .groupBy("l_returnflag")
        .agg(
            F.count("*").alias("n"),
            F.min("row_index").alias("first_row"),
            F.max("row_index").alias("last_row"),
            F.count_distinct("row_index").alias("places"),
        )
    )


@query(
    """SELECT doc_id AS value, count(*) AS affected_rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id"""
)
def reference_check(spark, sf_dir):
    return mg.check_references(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@query(
    """SELECT value, count(*) AS affected_rows FROM (SELECT unnest([l_partkey, l_suppkey * 40]) AS value FROM lineitem)
WHERE value NOT IN (SELECT p_partkey FROM part) GROUP BY value"""
)
def list_reference_check(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_partkey"), F.col("l_suppkey") * 40).alias("needs"))
    return mg.check_list_references(lines, "needs", table(spark, sf_dir, "part"), "p_partkey")


@query(
    """SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) - 10 AS not_shown FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"""
)
def top_with_remainder(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return with_remainder(customer, [F.desc("c_acctbal"), F.col("c_custkey")], 10)


@query(
    """SELECT row_index, o_orderkey, label, s_suppkey, label_1 FROM (
  SELECT row_number() OVER (ORDER BY o_orderkey * 7919 % 10007, o_orderkey) - 1 AS row_index, o_orderkey, 'o' || o_orderkey AS label FROM orders)
FULL JOIN (SELECT row_number() OVER (ORDER BY s_suppkey * 31 % 97, s_suppkey) - 1 AS row_index, s_suppkey, 's' || s_suppkey AS label_1 FROM supplier) USING (row_index)"""
)
def merge_file_order(spark, sf_dir):
    """Two written files side by side, row by row as they stand; their values are in no order."""

    def write(frame, name):
        path = _folder(spark, name)
        frame.write.csv(path, header=True)
        return read_file(spark, path)

    orders = table(spark, sf_dir, "orders").orderBy(F.expr("o_orderkey * 7919 % 10007"), "o_orderkey")
    supplier = table(spark, sf_dir, "supplier").orderBy(F.expr("s_suppkey * 31 % 97"), "s_suppkey")
    left = write(orders.selectExpr("o_orderkey", "concat('o', o_orderkey) AS label"), "left.csv")
    right = write(supplier.selectExpr("s_suppkey", "concat('s', s_suppkey) AS label"), "right.csv")
    return mg.side_by_side([left, right])


@query(
    r"""SELECT doc_id, regexp_replace(replace(left(text, 300), chr(92), '/'), '[^\x09-\x{FF}]', '?', 'g') AS head FROM documents WHERE trim(left(text, 300)) <> ''"""
)
def mixed_encodings(spark, sf_dir):
    """A folder of UTF-8, UTF-16 and Latin-1 files, loaded as one table."""
    path = _folder(spark, "mixed.csv")
    heads = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "regexp_replace(replace(left(text, 300), chr(92), '/'), '[^\\\\x09-\\\\x{FF}]', '?') AS head"
    ).where("trim(head) <> ''")
    for k, name in enumerate(("UTF-8", "UTF-16", "ISO-8859-1")):
        part = heads.where(F.col("doc_id") % 3 == k)
        part.write.csv(path, header=True, encoding=name, mode="append", escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_file(spark, path, encoding="auto").select("doc_id", "head")
