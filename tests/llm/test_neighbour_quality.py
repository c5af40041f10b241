import tracemalloc
import zlib

import numpy as np

from plumbline.llm import neighbour_quality as Q
from plumbline.llm.queries import held_out, training_labels
from pyspark.sql import functions as F

SMALL = Q.Space(folded=64, shapes=64, dimensions=8, per_class=40, voters=3)


def corpus():
    good = [(k, f"Plain words number {k} in a sentence, with commas. And one more sentence follows {k % 7}.") for k in range(40)]
    bad = [(100 + k, f"### {k} $$$ !!! ### %%% {k % 5} &&& *** " * 3) for k in range(40)]
    return good + bad


def model_of(table, rows=None, labels=None, space=SMALL):
    rows = corpus() if rows is None else rows
    labels = [(i, int(i < 100)) for i, _ in rows] if labels is None else labels
    return Q.train(table(rows), table(labels, "doc_id bigint, quality int"), space=space)


def test_scores_equal_brute_force_votes(table):
    model = model_of(table)
    texts = ["Some plain words, in a sentence. Another one.", "### $$$ 12 !!! ###", "Mixed words ### and $$$ signs, here."]
    counts = Q.term_counts(texts, SMALL)
    for text, row, score in zip(texts, counts, Q.vote(model, texts)):
        vector = Q._unit(Q._weighted(row[None], model.idf, SMALL) @ model.axes)[0]
        near = np.round(model.vectors @ vector, 5)
        last = sorted(near)[-3]
        votes = [(max(s, 1e-3) ** SMALL.power * w, y) for s, w, y in zip(near, model.weights, model.labels) if s >= last]
        assert abs(score - sum(v * y for v, y in votes) / sum(v for v, _ in votes)) < 1e-6, text


def test_term_counts_do_not_depend_on_the_batch():
    texts = [t for _, t in corpus()][::7] + ["", "a", "ab", "é漢字🙂"]
    alone = np.concatenate([Q.term_counts([t], SMALL) for t in texts])
    assert np.array_equal(alone, Q.term_counts(texts, SMALL))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scores = Q.score(docs, Q.train(docs, training_labels(spark, "/root/testdata/sf0.01")))
    rows = scores.join(labels.where(held_out(F.col("doc_id"))), "doc_id").collect()
    assert len(rows) > 40
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) >= 0.97


def test_held_out_ids_are_a_fifth_by_crc(spark):
    rows = spark.range(500).withColumn("h", held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_hard_cases(hard, table):
    model = model_of(table)
    rows = Q.score(hard, model).collect()
    assert len(rows) == hard.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (1, 2, 3)} == {model.prior}
    kept = Q.accepted(hard, model, 0.0)
    assert kept.columns == hard.columns and kept.count() == hard.count()


def test_labels_with_nulls_ties_and_strangers(table):
    labels = [(0, 1), (0, 0), (1, None), (None, 1), (2, 1), (999, 0), (101, 0), (101, 0)]
    model = model_of(table, labels=labels)
    assert sorted(model.labels.tolist()) == [0.0, 1.0]


def test_empty_tables(nothing, table):
    model = Q.train(nothing, table([], "doc_id bigint, quality int"), space=SMALL)
    assert Q.vote(model, ["any text"]).tolist() == [0.5]
    assert Q.score(nothing, model).count() == 0


def test_the_lowest_hashes_of_each_label_are_taken(spark):
    """With a bound on the hashes (many rows), without one (few), and with more asked for than there are."""
    agreed = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    sizes = {0: 36_000, 1: 4_000}
    hashed = sorted((r.h, r.doc_id, r.label) for r in agreed.withColumn("h", F.xxhash64("doc_id")).collect())
    for most in (200, 3000, 5000):
        want = {i for label in (0, 1) for _, i, _ in [x for x in hashed if x[2] == label][:most]}
        got = Q._lowest(agreed, sizes, most)
        assert got.columns == ["doc_id", "label"] and {r.doc_id for r in got.collect()} == want
    plan = Q._lowest(agreed, sizes, 200)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert Q._lowest(agreed.where("false"), {}, 5).count() == 0


def test_the_fit_equals_that_of_the_whole_matrix(table):
    model = model_of(table)
    counts = Q.term_counts([t for _, t in corpus()], SMALL)
    idf = np.log((len(counts) + 1) / ((counts > 0).sum(axis=0) + 1)).astype(np.float32) + 0.1
    weighted = Q._weighted(counts, idf, SMALL).astype(np.float64)
    axes = np.linalg.eigh(weighted.T @ weighted)[1][:, ::-1][:, : SMALL.dimensions]
    vectors = Q._unit(weighted @ axes)
    assert np.allclose(model.idf, idf) and model.labels.tolist() == [1.0] * 40 + [0.0] * 40
    assert np.allclose(model.vectors @ model.vectors.T, vectors @ vectors.T, atol=1e-4)


def test_the_driver_never_holds_the_terms_of_the_sample(table):
    space = Q.Space(folded=64, shapes=64, dimensions=8, per_class=2000, voters=3)
    rows = [(k, f"Plain words number {k}, with commas." if k % 2 else f"### {k} $$$ !!! ### %%%") for k in range(4000)]
    docs, labels = table(rows), table([(k, k % 2) for k, _ in rows], "doc_id bigint, quality int")
    tracemalloc.start()
    try:
        model = Q.train(docs, labels, space=space)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.labels) == 4000 and peak < 4000 * space.slots * 4, peak
