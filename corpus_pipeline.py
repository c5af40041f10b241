"""A corpus pipeline of the text operators: quality, exact and near copies, benchmark passages, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet into the shared folder and read again as the next stage's
``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, chosen_path, decontaminate, exact_dedup, neighbour_quality
from plumbline.llm.common import id_and_text, text_mark, without_rows
from plumbline.llm.queries import LEAST_QUALITY, training_labels
from plumbline.session import materialize


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels that are not held out.

    Texts without words get the share of good labels. Without labels all get 0.5 and stay.
    """
    model = neighbour_quality.train(docs, training_labels(spark, sf_dir))
    return neighbour_quality.accepted(docs, model, LEAST_QUALITY)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; null and empty are equal, rows that repeat id and text come once."""
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 or more of their five-word shingles the smallest id stays.

    Of several texts with that id one stays; a row without an id only if no other is connected with it.
    """
    return chosen_path.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark table.

    Rows that share an id are judged by their own texts: they are told apart by
    the text's digest. Null and empty texts hold none. No benchmark takes nothing out.
    """
    passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = id_and_text(docs)
    named = rows.select(F.struct("doc_id", text_mark(F.col("text")).alias("mark")).alias("doc_id"), "text")
    found = decontaminate.find_passages(named, passages)
    return without_rows(docs, materialize(found.select("doc_id.doc_id", "doc_id.mark").distinct()))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to; null and empty texts have no ids."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_texts),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("byte-level BPE", token_ids),
]

#: The classifier, the chosen paths and the byte-pair merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
