"""Rows that share ids, have none, or sit beside columns of clashing names, in every stage that drops rows."""

import corpus_pipeline
import pytest

from plumbline.llm import chosen_path, exact_dedup
from plumbline.llm.common import text_mark, without_rows
from pyspark.sql import functions as F

X = "one two three four five six seven eight nine ten"
Y = "a quite other text of several words that stands alone"



def by_place(df):
    return sorted(((r[0], r[1]) for r in df.collect()), key=repr)


def test_texts_of_their_own_stay_under_a_dropped_id(table):
    rows = [(1, X), (5, X), (5, Y)]
    for stage in (chosen_path.one_of_each, exact_dedup.exact_dedup):
        kept = stage(table(rows))
        assert by_place(kept) == [(1, X), (5, Y)] and kept.columns == table(rows).columns


def test_a_copy_without_an_id_goes(table):
    rows = [(None, X), (3, X), (None, Y)]
    for stage in (chosen_path.one_of_each, exact_dedup.exact_dedup):
        assert by_place(stage(table(rows))) == sorted([(3, X), (None, Y)], key=repr)


def test_near_copies_under_one_id_leave_one(table):
    near = " ".join(f"w{k}" for k in range(100))
    rows = [(1, near), (1, near + " more"), (2, near)]
    kept = by_place(chosen_path.one_of_each(table(rows)))
    assert len(kept) == 1 and kept[0][0] == 1


def test_passages_take_out_their_own_rows_only(spark, table, tmp_path):
    passage = "This sentence of the benchmark is long enough to be searched for in all texts."
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(7, f"Before it. {passage} After it."), (7, Y), (None, passage), (None, None), (8, X)]
    kept = by_place(corpus_pipeline.without_benchmarks(spark, table(rows), str(tmp_path)))
    assert kept == sorted([(7, Y), (None, None), (8, X)], key=repr)


def test_rows_are_matched_by_id_and_text(table):
    docs = table([(1, "a"), (1, "b"), (None, "a"), (None, None), (2, "")])
    gone = docs.sparkSession.createDataFrame([(1, "a"), (None, ""), (2, None)], "doc_id bigint, t string").select("doc_id", text_mark(F.col("t")).alias("mark"))
    assert by_place(without_rows(docs, gone)) == sorted([(1, "b"), (None, "a")], key=repr)


def test_unknown_and_double_names_are_refused(spark):
    with pytest.raises(ValueError):
        chosen_path.one_of_each(spark.createDataFrame([(1, "a")], "id int, text string"))
    with pytest.raises(ValueError):
        chosen_path.one_of_each(spark.createDataFrame([(1, 1, "a")], "Doc_id int, DOC_ID int, text string"))
