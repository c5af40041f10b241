"""Rows in the order of their files, and files of several encodings."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.errors import DuplicateKeys, LoadError, PlumblineError
from plumbline.operators.keys import check_unique, with_file_order
from plumbline.operators.merge import merge, side_by_side
from plumbline.plans.ingest import ingest
from plumbline.sources.encoding import file_encodings
from plumbline.sources.readers import read_file
from plumbline.sources.spec import SourceSpec


@pytest.fixture
def scrambled(tmp_path):
    """A CSV of many lines in no order of their values."""
    lines = [f"{k},{random.Random(k).randrange(10**9)}" for k in random.Random(1).sample(range(5000), 5000)]
    path = tmp_path / "scrambled.csv"
    path.write_text("k,v\n" + "\n".join(lines) + "\n")
    return str(path), [int(line.split(",")[0]) for line in lines]


def test_file_order_over_blocks(spark, scrambled):
    path, keys = scrambled
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        frame = read_file(spark, path)
        assert frame.rdd.getNumPartitions() > 5
        indexed = with_file_order(frame.select("k"))
        assert [r.k for r in indexed.orderBy("row_index").collect()] == keys
        assert indexed.agg(F.min("row_index"), F.max("row_index"), F.count_distinct("row_index")).first() == (0, 4999, 5000)
        every_third = with_file_order(frame.where("k % 3 = 0").select("k"), "place")
        assert [r.k for r in every_third.orderBy("place").collect()] == [k for k in keys if k % 3 == 0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_merge_row_by_row_without_orders(spark, scrambled, tmp_path):
    path, keys = scrambled
    (tmp_path / "names.jsonl").write_text("".join(f'{{"name": "n{k}", "v": {k}}}\n' for k in range(4000)))
    other = read_file(spark, str(tmp_path / "names.jsonl"))
    rows = side_by_side([read_file(spark, path), other]).orderBy("row_index").collect()
    assert [r.k for r in rows] == keys and [r.name for r in rows] == [f"n{k}" for k in range(4000)] + [None] * 1000
    assert rows[17].v_1 == 17
    assert merge([read_file(spark, path), other]).columns == ["k", "v", "name", "v_1"]
    both = ingest(spark, [SourceSpec(path, source_id="a"), SourceSpec(str(tmp_path / "names.jsonl"), source_id="b")])
    assert both.profile.where("column_name = 'k'").first()["row_count"] == 5000


def test_tables_without_files_have_no_order(spark):
    with pytest.raises(PlumblineError):
        merge([spark.range(3), spark.range(3).withColumnRenamed("id", "x")])
    with pytest.raises(PlumblineError):
        with_file_order(spark.range(3))


def test_encodings_of_a_folder(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    rows = {"a b.csv": ("utf-8", "é漢"), "u16.csv": ("utf-16", "ü漢"), "be.csv": ("utf-16-be", "ö"), "latin[1].csv": ("latin-1", "ß"), "sig.csv": ("utf-8-sig", "ñ"), "plain.csv": ("ascii", "n")}
    for number, (name, (encoding, text)) in enumerate(rows.items()):
        mark = "﻿" if encoding == "utf-16-be" else ""
        (folder / name).write_bytes(f"{mark}id,name\n{number},{text}\n".encode(encoding))
    (folder / "empty.csv").write_bytes(b"")
    found = {r.path.rsplit("/", 1)[1]: r.encoding for r in file_encodings(spark, str(folder)).collect()}
    assert found == {"a%20b.csv": "utf-8", "u16.csv": "utf-16-le", "be.csv": "utf-16-be", "latin%5B1%5D.csv": "latin-1", "sig.csv": "utf-8", "plain.csv": "utf-8"}
    frame = read_file(spark, str(folder), encoding="auto")
    assert frame.dtypes[0] == ("id", "int") or frame.dtypes[0] == ("id", "bigint")
    assert sorted(tuple(r) for r in frame.collect()) == [(k, text) for k, (_, text) in enumerate(rows.values())]


def test_other_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("id,name\n1,a\n".encode("utf-8"))
    (folder / "b.csv").write_bytes("id,other\n1,é\n".encode("latin-1"))
    with pytest.raises(LoadError):
        read_file(spark, str(folder), encoding="auto")


def test_a_long_latin_file_is_found_by_one_late_byte(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"id,name\n" + b"1,plain\n" * 50_000 + b"2,\xe9t\xe9\n")
    assert file_encodings(spark, str(path)).first().encoding == "latin-1"
    assert read_file(spark, str(path), encoding="auto").where("id = 2").first()["name"] == "été"


def test_keys_are_checked_by_hash_first(spark):
    frame = spark.range(1000).selectExpr("id", "id % 10 AS a", "map('k', id) AS m", "if(id = 3, null, id) AS n")
    for keys in (["id"], ["id", "a"], ["m"], ["n"]):
        check_unique(frame, keys)
    for keys in (["a"], ["a", "a"]):
        with pytest.raises(DuplicateKeys):
            check_unique(frame, keys)
    with pytest.raises(DuplicateKeys):
        check_unique(frame.selectExpr("if(id < 2, null, id) AS n"), ["n"])
