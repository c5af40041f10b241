"""The text operators applied to their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    byte_bpe,
    chosen_path,
    decontaminate,
    exact_dedup,
    html_paths,
    lexical,
    licenses,
    negatives,
    neighbour_quality,
    oracles,
    page_language,
    personal_data,
    secrets,
    simhash,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under its name, with its SQL if there is any."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op3_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query(oracles.EXACT_GROUPS)
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query(oracles.NEAR_DUPLICATES)
def op6_chosen_path(spark, sf_dir):
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op7_decontaminate(spark, sf_dir):
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that models may learn from; a fifth of the ids is held out."""
    return table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


#: Texts that score less are rejected.
LEAST_QUALITY = 0.3


@query()
def op8_neighbour_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = neighbour_quality.score(docs, neighbour_quality.train(docs, training_labels(spark, sf_dir)))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"),
    )


@query(oracles.SECRETS)
def op9_markov_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count_of(kind):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *map(count_of, secrets.KINDS),
        F.sha2(secrets.as_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.as_text(F.col("findings")).alias("spans"),
    )


@query()
def op5_boosted_pii(spark, sf_dir):
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents"))

    def count_of(kind):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda s: s["kind"].isin(*personal_data.KINDS))
    return found.select(
        "doc_id",
        *map(count_of, personal_data.KINDS + personal_data.ADDED),
        F.sha2(secrets.as_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.as_text(F.col("findings")).alias("spans"),
    )


@query()
def op1_html_paths(spark, sf_dir):
    return html_paths.extract(table(spark, sf_dir, "pages"))


@query()
def op2_page_language(spark, sf_dir):
    model = page_language.train(table(spark, sf_dir, "documents"))
    return page_language.identify(table(spark, sf_dir, "pages"), model)


@query()
def op10_license_dice(spark, sf_dir):
    return licenses.find_licences(table(spark, sf_dir, "documents"), every=True)


@query(oracles.RANKED_SEARCH)
def op11_block_max(spark, sf_dir):
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    ranked = lexical.search(index, table(spark, sf_dir, "benchmark"))
    index.release()
    return ranked


@query()
def op12_covering_simhash(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query(oracles.HARD_NEGATIVES)
def op13_tree_negatives(spark, sf_dir):
    vectors, vec_id = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    moved = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), vec_id % 100 == 0)
