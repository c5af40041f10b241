import json

import pandas as pd
import pytest

from plumbline.errors import LoadError, QueryError, SourceNotFound, UnsupportedFormat
from plumbline.operators.casts import apply_casts, infer_casts, suggest_casts
from plumbline.sources import spec as S
from plumbline.sources.encoding import detect_encodings, encoding_of
from plumbline.sources.readers import load_with_status, read_file, supported_extensions
from plumbline.sources.sinks import write_report_tables
from plumbline.sources.views import SqlViews


@pytest.fixture
def write(tmp_path):
    def to(name, content):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return to


def test_clean_csv_gets_types(spark, write):
    path = write("clean.csv", "id,name,score,active,day\n1,ann,1.5,true,2024-01-01\n2,bob,2.5,false,2024-01-02\n")
    df = read_file(spark, path)
    assert df.dtypes == [
        ("id", "bigint"), ("name", "string"), ("score", "double"), ("active", "boolean"), ("day", "date")
    ]
    assert df.count() == 2


def test_null_tokens_and_blank_cells(spark, write, rows):
    path = write("messy.csv", "id,value,status\n1,100,ok\n2,N/A,\n3,NULL,bad\n4,200,-\n")
    assert rows(read_file(spark, path), "id") == [
        {"id": 1, "value": 100, "status": "ok"},
        {"id": 2, "value": None, "status": None},
        {"id": 3, "value": None, "status": "bad"},
        {"id": 4, "value": 200, "status": None},
    ]


def test_own_null_tokens(spark, write, rows):
    path = write("own.csv", "id,value\n1,?\n2,7\n")
    assert rows(read_file(spark, path, null_tokens=["?"]), "id")[0]["value"] is None


def test_ragged_rows_are_cut_or_filled(spark, write, rows):
    path = write("ragged.csv", "a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    df = read_file(spark, path, keep_corrupt=True)
    got = rows(df, "a")
    assert [(r["a"], r["b"], r["c"]) for r in got] == [(1, 2, 3), (4, 5, None), (6, 7, 8)]
    assert [r["_corrupt_record"] for r in got] == [None, "4,5", "6,7,8,9"]


def test_tsv_and_byte_order_mark(spark, write):
    assert read_file(spark, write("t.tsv", "a\tb\n1\tx\n")).columns == ["a", "b"]
    assert read_file(spark, write("bom.csv", b"\xef\xbb\xbfid,name\n1,x\n")).columns == ["id", "name"]


def test_quotes_inside_quotes(spark, write, rows):
    assert rows(read_file(spark, write("q.csv", 'a,b\n1,"say ""hi"", ok"\n')))[0]["b"] == 'say "hi", ok'


def test_empty_and_header_only_csv(spark, write):
    with pytest.raises(LoadError):
        read_file(spark, write("zero.csv", ""))
    df = read_file(spark, write("head.csv", "id,value,label\n"))
    assert df.columns == ["id", "value", "label"] and df.count() == 0


def test_missing_and_unknown_files(spark, write):
    for name in ("gone.csv", "gone.parquet", "gone.json"):
        with pytest.raises(SourceNotFound):
            read_file(spark, f"/nowhere/{name}")
    with pytest.raises(UnsupportedFormat):
        read_file(spark, write("x.xlsx", "?"))
    assert supported_extensions() == [".csv", ".tsv", ".parquet", ".json", ".jsonl", ".ndjson"]


def test_row_cap(spark, write):
    path = write("cap.csv", "id\n" + "\n".join(map(str, range(50))))
    assert read_file(spark, path, row_cap=10).count() == 10


@pytest.mark.parametrize(
    ("name", "content", "count"),
    [
        ("lines.jsonl", '{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n', 2),
        ("lines.ndjson", '\n{"id": 1, "v": "a"}\n', 1),
        ("array.json", json.dumps([{"id": i, "v": "x"} for i in range(5)], indent=1), 5),
        ("flat.json", json.dumps([{"id": i, "v": "x"} for i in range(3)]), 3),
        ("one.json", json.dumps({"id": 1, "v": "x"}, indent=2), 1),
    ],
)
def test_json_layouts(spark, write, name, content, count):
    df = read_file(spark, write(name, content))
    assert df.columns == ["id", "v"] and df.count() == count


@pytest.mark.parametrize("content", ["", "plain text", "{not json", '"text"'])
def test_bad_json_raises(spark, write, content):
    with pytest.raises(LoadError):
        read_file(spark, write("bad.json", content))


def test_parquet(spark, tmp_path):
    path = tmp_path / "p.parquet"
    pd.DataFrame({"x": [1, 2, 3], "y": [0.5, 1.5, 2.5], "label": list("abc")}).to_parquet(path)
    assert read_file(spark, str(path)).count() == 3


def test_encodings(spark, write, rows):
    paths = {
        write("a.txt", b"\xef\xbb\xbfhi"): "utf-8-sig",
        write("b.txt", "hi".encode("utf-16")): "utf-16-le",
        write("c.txt", b"\xfe\xff\x00h"): "utf-16-be",
        write("d.txt", "grüße"): "utf-8",
        write("e.txt", "grüße".encode("latin-1")): "latin-1",
        write("f.txt", b"a" * 5000 + b"\xfc"): "latin-1",
        "/nowhere/f.txt": None,
    }
    found = rows(detect_encodings(spark.createDataFrame([(p,) for p in paths], "path string")))
    assert {r["path"]: r["encoding"] for r in found} == paths
    assert [r["path"] for r in found if r["error"]] == ["/nowhere/f.txt"]
    assert encoding_of([("a" * 4095 + "ü").encode()[:4096], ("ü".encode())[1:]]) == "utf-8"
    assert encoding_of([b"cut \xc3"]) == "latin-1"


def test_kind_from_uri():
    kinds = {
        "a.csv": "csv", "B.PARQUET": "parquet", "c.json": "json", "d.jsonl": "json", "e.tsv": "unknown",
        "f.ndjson": "unknown", "g.duckdb": "duckdb", "postgresql://h/db::t": "postgres", "postgres://h/db::t": "postgres",
    }
    assert {u: S.SourceSpec(u).kind for u in kinds} == kinds
    assert S.SourceSpec("a.csv", "json").kind == "json"
    assert S.SourceSpec("  a.csv ").uri == "a.csv"
    with pytest.raises(ValueError):
        S.SourceSpec("   ")


def test_object_store_paths():
    assert S.hadoop_path("s3://bucket/a.parquet") == "s3a://bucket/a.parquet"
    assert S.hadoop_path("/data/a.parquet") == "/data/a.parquet"
    assert S.SourceSpec("s3://bucket/a.parquet").kind == "parquet"


def test_postgres_uri():
    table = S.parse_postgres("postgresql://me:p%40ss@db.local:5433/shop::sales.orders")
    assert table.url == "jdbc:postgresql://db.local:5433/shop"
    assert table.dbtable == "sales.orders"
    assert (table.properties["user"], table.properties["password"]) == ("me", "p@ss")
    assert S.parse_postgres("postgres://h/db::orders").dbtable == "public.orders"
    with pytest.raises(LoadError):
        S.parse_postgres("postgresql://h/db")


def test_load_with_status(spark, write, rows):
    good = write("good.csv", "a,b\n1,2\n3\n")
    loaded = load_with_status(
        spark, [S.SourceSpec(good, source_id="good"), S.SourceSpec("/nowhere/x.csv", source_id="bad")]
    )
    assert list(loaded.frames) == ["good"] and loaded.frames["good"].columns == ["a", "b"]
    status = {r["source_id"]: r for r in rows(loaded.status)}
    assert (status["good"]["tier"], status["good"]["row_count"], status["good"]["corrupt_rows"]) == ("none", 2, 1)
    assert "1 rows" in status["good"]["warning"]
    assert status["bad"]["tier"] == "degraded" and "not found" in status["bad"]["warning"]


def test_integers_beyond_64_bits_and_odd_numbers_stay_text(spark, write, rows):
    df = read_file(spark, write("big.csv", "a,b,c\n12345678901234567890,--5,1e999\n1,2,3\n"))
    assert [t for _, t in df.dtypes] == ["string", "string", "string"]
    assert rows(df, "b")[0]["b"] == "--5" and df.where("a IS NULL").count() == 0


def test_quoted_line_breaks(spark, write, rows):
    df = read_file(spark, write("q.csv", 'k,t\n1,"line one\nline two"\n2,"say ""hi"""\n'))
    assert rows(df, "k") == [{"k": 1, "t": "line one\nline two"}, {"k": 2, "t": 'say "hi"'}]


def test_files_with_other_headers_raise(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,x\n")
    (folder / "2.csv").write_text("b,a\ny,2\n")
    with pytest.raises(LoadError):
        read_file(spark, str(folder))


def test_half_broken_json_raises(spark, write):
    path = write("half.jsonl", '{"a": 1}\n{"a": \n')
    with pytest.raises(LoadError):
        read_file(spark, path)
    kept = read_file(spark, path, keep_corrupt=True)
    assert [r._corrupt_record for r in kept.collect()].count(None) == 1


SALES = "date,revenue,units,region\n2024-01-01,1000.5,10,north\n2024-01-02,900,9,south\n2024-01-03,1100,11,north\n2024-01-04,1200,12,east\n2024-01-05,1250,13,west\n"


def test_sql_views(spark, write):
    views = SqlViews(spark, row_cap=3)
    name = views.register(S.SourceSpec(write("sales.csv", SALES), name="sales"))
    assert views.rows("SELECT sum(revenue) FROM sales") == [(5450.5,)]
    assert views.query("SELECT * FROM sales WHERE region = 'north'").count() == 2
    assert views.query("SELECT * FROM sales").count() == 3
    assert views.query("SELECT * FROM sales", row_cap=None).count() == 5
    assert views.query("SELECT * FROM sales LIMIT 2").count() == 2
    assert SqlViews(spark).query("SELECT * FROM range(600000)").count() == 600_000
    with pytest.raises(QueryError):
        views.rows("SELECT * FROM sales", most=4)
    assert views.sample("sales", 2).count() == 2
    assert views.row_count("sales") == 5
    assert views.column_names("sales") == ["date", "revenue", "units", "region"]
    assert views.views() == [name] == ["sales"]
    source = S.SourceSpec(write("other.csv", SALES), source_id="abc")
    assert views.register(source) == "source_abc"


def test_sql_errors_are_one_type(spark):
    views = SqlViews(spark)
    for text in ("SELECT * FROM nowhere_at_all", "SELEC 1"):
        with pytest.raises(QueryError):
            views.query(text)
    with pytest.raises(QueryError):
        views.rows("SELECT 1 / 0")
    with pytest.raises(QueryError):
        views.row_count("nowhere_at_all")


def test_view_of_missing_or_unreadable_source(spark, write):
    with pytest.raises(SourceNotFound):
        SqlViews(spark).register(S.SourceSpec("/nowhere/x.csv"))
    for name in ("x.abc", "x.duckdb", "noext"):
        with pytest.raises(UnsupportedFormat):
            SqlViews(spark).register(S.SourceSpec(write(name, "a\n1\n")))
    assert SqlViews(spark).register(S.SourceSpec(write("plain", "a\n1\n"), "csv", name="plain")) == "plain"


def test_report_tables_are_written(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.range(2)}
    paths = write_report_tables(tables, str(tmp_path / "report"))
    assert spark.read.json(paths["a"]).count() == 3 and spark.read.json(paths["b"]).count() == 2


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(
        [("1", "1.5", "true", "2024-01-01", "x", None), (" -2", "2", "No", "2024/01/02", "y", None), ("3", "3e2", "on", "03-01-2024", "z", None)],
        "id string, price string, flag string, day string, name string, nothing string",
    )


def test_suggest_casts(spark, texts):
    assert suggest_casts(texts) == {"id": "Int64", "price": "Float64", "flag": "Boolean", "day": "Date"}
    assert suggest_casts(texts.where("false")) == {}
    assert suggest_casts(spark.range(3)) == {}
    ones = spark.createDataFrame([("1",), ("0",)], "bit string")
    assert suggest_casts(ones) == {"bit": "Int64"}


def test_suggestion_shares(spark):
    def suggestion(good, bad, n_bad):
        return suggest_casts(spark.createDataFrame([(good,)] * (10 - n_bad) + [(bad,)] * n_bad, "c string")).get("c")

    assert suggestion("7", "x", 1) == "Int64" and suggestion("7", "x", 2) is None
    assert suggestion("7", "7.5", 2) == "Float64"
    assert suggestion("2024-05-06", "x", 2) == "Date" and suggestion("2024-05-06", "x", 3) is None
    assert suggestion("yes", "maybe", 1) is None and suggestion("yes", " ", 1) == "Boolean"


def test_apply_casts(spark, texts, rows):
    casts = {"id": "Int64", "price": "Float64", "flag": "Boolean", "day": "Date", "name": "Int64", "gone": "Int64", "nothing": "What"}
    df = apply_casts(texts, casts)
    assert dict(df.dtypes) == {
        "id": "bigint", "price": "double", "flag": "boolean", "day": "date", "name": "bigint", "nothing": "string"
    }
    got = rows(df, "id")
    assert [r["id"] for r in got] == [-2, 1, 3]
    assert [r["flag"] for r in got] == [False, True, True]
    assert [str(r["day"]) for r in got] == ["2024-01-02", "2024-01-01", "2024-01-03"]
    assert all(r["name"] is None for r in got)
    assert apply_casts(spark.createDataFrame([("5.0",), ("x",)], "a string"), {"a": "Int64"}).where("a IS NULL").count() == 2
    assert apply_casts(spark.range(1), {"id": "Utf8"}).dtypes == [("id", "string")]


def test_inferred_casts_lose_nothing(spark):
    df = spark.createDataFrame([("1", "2024-01-01 10:00:00")] * 19 + [("x", "2024-01-01T11:30:00")], "a string, t string")
    assert infer_casts(df) == {"t": "Datetime"}


def test_codes_with_leading_zeros_stay_text(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("zip,share,plain\n00123,0.5,0\n10115,0.75,10\n")
    frame = read_file(spark, str(path))
    assert [dict(frame.dtypes)[c] for c in ("zip", "share", "plain")] == ["string", "double", "bigint"]
    assert sorted(r.zip for r in frame.collect()) == ["00123", "10115"]
