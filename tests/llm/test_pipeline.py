import hashlib

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from plumbline.llm import decontaminate, neighbour_quality
from plumbline.llm.queries import LEAST_QUALITY, ORACLES, QUERIES, training_labels
from plumbline.session import materialize
from tests.llm.test_chosen_path import brute
from tests.parity_check import connect, differences

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert {"pipeline", *QUERIES} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_queries_equal_their_sql(spark):
    connection = connect(SF_DIR)
    for name, sql in ORACLES.items():
        assert differences(spark, connection, name, QUERIES[name], sql, SF_DIR) is None


def test_every_stage_keeps_what_it_should(spark):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    model = neighbour_quality.train(docs, training_labels(spark, SF_DIR))
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = materialize(stage(spark, docs, SF_DIR))
        steps.append((before, docs))
    kept = [{r.doc_id for r in after.select("doc_id").collect()} for _, after in steps]
    assert all(after.columns == columns for _, after in steps[:-1])

    texts = steps[0][0]
    scores = neighbour_quality.vote(model, [t or "" for _, t in texts])
    assert kept[0] == {i for (i, _), s in zip(texts, scores) if s >= LEAST_QUALITY}
    smallest = {}
    for i, t in steps[1][0]:
        smallest[t] = min(i, smallest.get(t, i))
    assert kept[1] == set(smallest.values())
    assert kept[2] == {c for _, c, *_ in brute(steps[2][0])}
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    verbatim = {i for i, t in steps[3][0] for p in items if p in t}
    gone = {i for i, _ in steps[3][0]} - kept[3]
    assert verbatim <= gone
    index = decontaminate.PassageIndex(list(enumerate(items)), decontaminate.Lemma())
    assert gone == {i for i, t in steps[3][0] if index.search([t])}
    rows = {r.doc_id: r.decoded_sha256 for r in steps[4][1].collect()}
    assert rows == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in steps[4][0]}


def test_run_gives_the_rows_of_the_stages(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
