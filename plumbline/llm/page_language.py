"""Language of web pages by Bayesian fusion of text, markup, address and host.

Text: naive Bayes over hashed character trigrams, trained on a bounded sample
of labelled documents. Declared language and address suffix: how likely each
value is in pages of a language, counted over all pages with the text's
posterior as weights. Host: a prior per host, smoothed towards its domain's,
which is smoothed towards that of all pages; a page's own weight is taken out
before it meets its host's. All counts are grouped sums of one row per page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.characters import END, fold, mix
from plumbline.llm.common import join_groups, picked, text_batches
from plumbline.llm.html_paths import main_blocks
from plumbline.session import materialize, ship_package


@dataclass(frozen=True)
class Fusion:
    """Trigram slots, labelled texts per language at most (lowest id hashes), trigrams that a text counts for at most
    (the rest only sharpens their mean), rows that a host's and a domain's parent count for, counts added to each value,
    slots that address suffixes share."""

    slots: int = 1 << 14
    per_language: int = 1000
    effective: float = 60.0
    parent_rows: float = 10.0
    smoothing: float = 1.0
    suffixes: int = 4096


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    log_odds: np.ndarray  # languages x slots
    slots: int


def _grams(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and slot of every trigram."""
    characters, _ = fold(texts)
    if len(characters) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = characters.astype(np.uint64)
    grams = (wide[:-2] << np.uint64(42)) ^ (wide[1:-1] << np.uint64(21)) ^ wide[2:]
    inside = (characters[:-2] != END) & (characters[1:-1] != END) & (characters[2:] != END)
    ends = np.flatnonzero(characters == END)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=-1))[: len(grams)]
    return owner[inside], (mix(grams[inside]) % np.uint64(slots)).astype(np.int64)


def _counted(slots: int):
    def run(batches):
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            owner, slot = _grams(batch.column("text").to_pylist(), slots)
            names = sorted(set(languages))
            number = np.array([names.index(x) for x in languages], np.int64)
            counts = np.bincount(number[owner] * slots + slot, minlength=1)
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in found // slots], pa.string()), pa.array((found % slots).astype(np.int32)), pa.array(counts[found])],
                ["lang", "slot", "n"],
            )

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fusion: Fusion = Fusion()) -> TextModel:
    """The text model of the languages in ``lang_col``; rows without a language or a text are not used."""
    ship_package(docs.sparkSession)
    rows = picked(docs, i=id_col, lang=lang_col, text=text_col).where(
        "lang IS NOT NULL AND lang <> '' AND text <> ''"
    )
    lowest = Window.partitionBy("lang").orderBy(F.xxhash64("i"), "i")
    sample = rows.select("i", "lang").withColumn("__rank", F.row_number().over(lowest)).where(F.col("__rank") <= fusion.per_language)
    texts = rows.join(F.broadcast(sample.select("i", "lang").distinct()), ["i", "lang"], "left_semi").select("lang", "text")
    counts = texts.mapInArrow(_counted(fusion.slots), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(set(counts["lang"].to_pylist())))
    table = np.full((len(languages), fusion.slots), 0.5)
    for lang, slot, n in zip(*(counts[c].to_pylist() for c in ("lang", "slot", "n"))):
        table[languages.index(lang), slot] += n
    table = np.log(table / table.sum(axis=1, keepdims=True)) if len(languages) else table
    return TextModel(languages, table, fusion.slots)


_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def _evidence(model: TextModel, fusion: Fusion):
    languages = {name: k for k, name in enumerate(model.languages)}

    def run(batches):
        for batch in text_batches(batches, chars=1_000_000):
            pages = batch.column("text").to_pylist()
            owner, slot = _grams(["\n".join(main_blocks(page)) for page in pages], model.slots)
            n = np.bincount(owner, minlength=len(pages))
            sums = np.stack([np.bincount(owner, row[slot], minlength=len(pages)) for row in model.log_odds], axis=1)
            scale = np.minimum(n, fusion.effective) / np.maximum(n, 1)
            likely = sums * scale[:, None]
            likely -= likely.max(axis=1, keepdims=True)
            weight = np.exp(likely)
            weight /= weight.sum(axis=1, keepdims=True)
            found = [_DECLARED.search(page[: page.find(">", page.lower().find("<html")) + 1] if "<html" in page.lower() else "") for page in pages]
            declared = [None if m is None else m.group(1).lower() if m.group(1).lower() in languages else "other" for m in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(declared, pa.string()),
                    pa.array(n, pa.int64()),
                    pa.array(list(likely), pa.list_(pa.float64())),
                    pa.array(list(weight), pa.list_(pa.float64())),
                ],
                ["page_id", "url", "declared", "n_trigrams", "likely", "weight"],
            )

    return run


def _sums(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Summed weights per key, as one array, and the rows of the key; partial sums in the tasks first."""
    sums = [F.sum(F.get("weight", F.lit(k))).alias(f"s{k}") for k in range(size)]
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_rows"), *sums).select(
        key, f"{name}_rows", F.array(*(F.col(f"s{k}") for k in range(size))).alias(name)
    )


def _value_table(sums: DataFrame, key: str, name: str, total: Column, size: int, values: int, smoothing: float) -> DataFrame:
    """Log-likelihood of a value under each language."""
    part = [F.log((F.get(name, F.lit(k)) + smoothing) / (F.get(total, F.lit(k)) + smoothing * values)) for k in range(size)]
    return sums.select(key, F.array(*part).alias(f"log_{name}"))


def identify(
    pages: DataFrame,
    model: TextModel,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    fusion: Fusion = Fusion(),
) -> DataFrame:
    """page_id, url, lang, score, text_lang, declared, host, n_trigrams of every row.

    ``score`` is the posterior of ``lang``; ties go to the language that comes
    first by name. A null or empty page has no text and no declaration, a null
    or odd url no host and no suffix: such evidence is left out, and a page
    without any gets the languages' shares among all pages. Repeated rows
    count each time. Without languages in the model lang and score are null.
    """
    ship_package(pages.sparkSession)
    source = picked(pages, page_id=id_col, url=url_col, text=html_col).withColumn("text", F.coalesce("text", F.lit("")))
    size = len(model.languages)
    if not size:
        return source.selectExpr(
            "page_id", "url", "CAST(NULL AS string) AS lang", "CAST(NULL AS double) AS score", "CAST(NULL AS string) AS text_lang",
            "CAST(NULL AS string) AS declared", "CAST(NULL AS string) AS host", "0L AS n_trigrams",
        )
    schema = T.StructType(
        [
            *source.schema.fields[:2],
            T.StructField("declared", T.StringType()),
            T.StructField("n_trigrams", T.LongType()),
            T.StructField("likely", T.ArrayType(T.DoubleType())),
            T.StructField("weight", T.ArrayType(T.DoubleType())),
        ]
    )
    host = F.nullif(F.regexp_extract(F.lower(F.col("url").cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))
    last = F.regexp_extract("host", r"([^.]+)$", 1)
    rows = materialize(
        source.mapInArrow(_evidence(model, fusion), schema)
        .withColumn("host", host)
        .withColumn("domain", F.regexp_extract("host", r"([^.]+(?:\.[^.]+)?)$", 1))
        .withColumn("suffix", F.pmod(F.xxhash64(last), F.lit(fusion.suffixes)).cast("int"))
        .withColumn("suffix", F.when(F.col("host").isNotNull(), F.col("suffix")))
    )
    # Every page, and those with each kind of evidence: one row of sums.
    total = rows.groupBy().agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.sum(F.get("weight", F.lit(k))).alias(f"a{k}") for k in range(size)),
        *(F.sum(F.when(F.col("declared").isNotNull(), F.get("weight", F.lit(k)))).alias(f"d{k}") for k in range(size)),
        *(F.sum(F.when(F.col("suffix").isNotNull(), F.get("weight", F.lit(k)))).alias(f"u{k}") for k in range(size)),
    ).first()

    def numbers(letter: str) -> Column:
        return F.array(*(F.lit(float(total[f"{letter}{k}"] or 0.0)) for k in range(size)))

    everything = [float(total[f"a{k}"] or 0.0) for k in range(size)]
    world = F.array(*(F.lit((x + fusion.smoothing) / (sum(everything) + fusion.smoothing * size)) for x in everything))
    declared = _value_table(_sums(rows.where("declared IS NOT NULL"), "declared", size, "markup"), "declared", "markup", numbers("d"), size, size + 1, fusion.smoothing)
    suffix = _value_table(_sums(rows.where("suffix IS NOT NULL"), "suffix", size, "address"), "suffix", "address", numbers("u"), size, fusion.suffixes, fusion.smoothing)
    hosts = _sums(rows.where("host IS NOT NULL"), "host", size, "of_host")
    domains = materialize(_sums(rows.where("host IS NOT NULL"), "domain", size, "of_domain"))

    # Both tables of values are small by construction: languages + 1 and ``suffixes`` rows.
    joined = rows.join(F.broadcast(declared), "declared", "left").join(F.broadcast(suffix), "suffix", "left")
    joined = join_groups(joined, materialize(hosts), "host", "of_host_rows", total["rows"], "left")
    joined = join_groups(joined, domains, "domain", "of_domain_rows", total["rows"], "left")

    none = F.array(*(F.lit(0.0) for _ in range(size)))
    names = F.array(*map(F.lit, model.languages))

    def without_own(name: str, k: int) -> Column:
        return F.greatest(F.get(name, F.lit(k)) - F.get("weight", F.lit(k)), F.lit(0.0))

    rest = fusion.parent_rows
    scores = []
    for k in range(size):
        domain = (without_own("of_domain", k) + rest * F.get(world, F.lit(k))) / (F.col("of_domain_rows") - 1 + rest)
        parent = F.coalesce(domain, F.get(world, F.lit(k)))
        prior = F.coalesce((without_own("of_host", k) + rest * parent) / (F.col("of_host_rows") - 1 + rest), parent)
        scores.append(F.log(prior) + F.get("likely", F.lit(k)) + F.get(F.coalesce("log_markup", none), F.lit(k)) + F.get(F.coalesce("log_address", none), F.lit(k)))
    fused = joined.withColumn("fused", F.array(*scores)).withColumn("top", F.array_max("fused"))
    spread = F.aggregate("fused", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("top")))
    return fused.select(
        "page_id",
        "url",
        F.get(names, (F.array_position("fused", F.col("top")) - 1).cast("int")).alias("lang"),
        (1 / spread).alias("score"),
        F.when(F.col("n_trigrams") > 0, F.get(names, (F.array_position("likely", F.array_max("likely")) - 1).cast("int"))).alias("text_lang"),
        "declared",
        "host",
        "n_trigrams",
    )
