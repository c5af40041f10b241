"""Text quality by votes of the nearest labelled texts in a latent-semantic space.

Terms are character trigrams, once of the folded text and once of its shape
(letters by case, digits, line ends, punctuation as it is), hashed into fixed
numbers of slots, and counts of words that repeat the word before or an earlier
one. Term weights (log counts times inverse document frequency) of a bounded
sample of labelled texts are reduced by a singular value decomposition: tasks
sum the products of terms, and the driver holds one matrix of slots by slots,
never the sample's terms. The sample's vectors are broadcast; every text gets
exact cosines with all of them, block by block, and the nearest vote with their
similarity.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.characters import END, fold, mix, word_hashes
from plumbline.llm.common import id_and_text, one_thread, picked, place_of, positioned, text_batches
from plumbline.session import materialize, release, ship_package


@dataclass(frozen=True)
class Space:
    """Slots of folded and of shape trigrams, dimensions kept, labelled texts per class at most, voters, sharpness of votes."""

    folded: int = 768
    shapes: int = 512
    dimensions: int = 64
    per_class: int = 3000
    voters: int = 25
    power: float = 8.0

    @property
    def slots(self) -> int:
        return self.folded + self.shapes + 3


@dataclass(frozen=True)
class Model:
    """What scoring needs; its size is bounded by ``space``: projection, sample vectors, their labels and weights."""

    space: Space
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float


@lru_cache(maxsize=1)
def _shapes() -> np.ndarray:
    table = np.arange(1 << 16, dtype=np.uint32)
    for number in range(1 << 16):
        character = chr(number)
        if character == "\n":
            continue
        if character.isspace():
            table[number] = ord(" ")
        elif character.isdigit():
            table[number] = ord("0")
        elif character.isupper():
            table[number] = ord("A")
        elif character.isalpha():
            table[number] = ord("a")
    return table


def _trigram_counts(characters: np.ndarray, stops: np.ndarray, n: int, slots: int, seed: int) -> np.ndarray:
    single = (characters * np.uint32(0x9E3779B1) + np.uint32(seed)) ^ (characters >> np.uint32(7))
    grams = (single[:-2] * np.uint32(31) + single[1:-1]) * np.uint32(0x85EBCA6B) + single[2:]
    slot = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(8)) % np.uint32(slots)
    first = np.repeat(np.arange(n, dtype=np.int64) * slots, np.diff(stops, prepend=-1))[: len(slot)]
    place = first + slot
    ends = stops[:-1]
    for over in (ends, ends - 1, ends - 2, stops[-1:] - 1, stops[-1:] - 2):
        over = over[(over >= 0) & (over < len(place))]
        place[over] = n * slots
    return np.bincount(place, minlength=n * slots + 1)[: n * slots].reshape(n, slots)


def term_counts(texts: list[str], space: Space) -> np.ndarray:
    """One row of term counts per text."""
    n = len(texts)
    folded, _ = fold(texts)
    stops = np.flatnonzero(folded == END)
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    shape = np.where(raw < 1 << 16, _shapes()[np.minimum(raw, (1 << 16) - 1)], np.uint32(ord("a")))
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    shape[ends] = END
    counts = np.zeros((n, space.slots), np.float32)
    if len(folded) > 2:
        counts[:, : space.folded] = _trigram_counts(folded, stops, n, space.folded, 1)
    if len(shape) > 2:
        counts[:, space.folded : -3] = _trigram_counts(shape, ends, n, space.shapes, 2)
    words, starts = word_hashes(folded)
    if len(words):
        owner = np.searchsorted(stops, starts)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        _, different = np.unique(mix(words + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        total = np.bincount(owner, minlength=n)
        counts[:, -3] = np.bincount(owner[again], minlength=n)
        counts[:, -2] = total - np.bincount(owner[different], minlength=n)
        counts[:, -1] = total
    return counts


def _weighted(counts: np.ndarray, idf: np.ndarray, space: Space) -> np.ndarray:
    """Log counts times idf; each of the three kinds of terms has length one."""
    weighted = np.log1p(counts) * idf
    for a, b in ((0, space.folded), (space.folded, space.slots - 3), (space.slots - 3, space.slots)):
        part = weighted[:, a:b]
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return weighted


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def _count_rows(space: Space):
    def run(batches):
        for batch in text_batches(batches, chars=1_000_000):
            counts = term_counts(batch.column("text").to_pylist(), space)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.tobytes() for c in counts], pa.binary())], ["doc_id", "counts"])

    return run


#: Tasks that the bounded sample is dealt to; each sends a matrix of slots by slots to the driver, one after the other.
FIT_TASKS = 4


def _matrices(batches, space: Space):
    """The counts of a few hundred rows at a time, with the rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield part, np.frombuffer(b"".join(part.column("counts").to_pylist()), np.float32).reshape(-1, space.slots)


def _held(space: Space):
    """How many texts a task has, and how many of them hold each term."""

    def run(batches):
        total = np.zeros(1 + space.slots, np.int64)
        for _, counts in _matrices(batches, space):
            total += np.r_[len(counts), (counts > 0).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _products(space: Space, idf: np.ndarray):
    """The sums of the products of every two terms' weights over a task's texts, a row for each term."""

    def run(batches):
        total = np.zeros((space.slots, space.slots))
        for _, counts in _matrices(batches, space):
            weighted = _weighted(counts, idf, space).astype(np.float64)
            total += weighted.T @ weighted
        slots = pa.array(np.arange(space.slots, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([slots, pa.array([row.tobytes() for row in total], pa.binary())], ["slot", "sums"])

    return run


def _projected(space: Space, idf: np.ndarray, axes: np.ndarray):
    def run(batches):
        for batch, counts in _matrices(batches, space):
            vectors = _unit(_weighted(counts, idf, space) @ axes).astype(np.float32)
            columns = [batch.column("doc_id"), batch.column("label"), pa.array([v.tobytes() for v in vectors], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "vector"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    space: Space = Space(),
) -> Model:
    """Fit the space and keep the labelled vectors.

    ``labels`` (the id column and a 0/1 label) should hold training rows only.
    At most ``space.per_class`` texts of each class are used, those whose ids
    hash lowest, and the classes are weighed back to their real shares. Null
    labels and ids with as many zeros as ones are left out. Without any
    labelled text the model gives every text 0.5.
    """
    one_thread()
    source = id_and_text(docs, id_col, text_col)
    agreed = materialize(
        picked(labels, doc_id=id_col, label=label_col)
        .select("doc_id", F.col("label").cast("double").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg("label").alias("label"))
        .where("label <> 0.5")
        .select("doc_id", (F.col("label") > 0.5).cast("int").alias("label"))
    )
    sizes = {r.label: r["count"] for r in agreed.groupBy("label").count().collect()}
    sample = _lowest(agreed, sizes, space.per_class)
    counted = source.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").mapInArrow(
        _count_rows(space), T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("counts", T.BinaryType())])
    )
    once = counted.groupBy("doc_id").agg(F.min("counts").alias("counts"))  # an id with several texts counts once
    stored = materialize(once.join(F.broadcast(sample), "doc_id"))  # bounded: 2 * per_class rows of slots numbers
    rows = stored.coalesce(FIT_TASKS)
    held = np.zeros(1 + space.slots, np.int64)
    for row in rows.mapInArrow(_held(space), "sums binary").toLocalIterator():
        held += np.frombuffer(row.sums, np.int64)
    n = int(held[0])
    if not n:
        zero = np.zeros((0, space.dimensions), np.float32)
        return Model(space, np.zeros(space.slots, np.float32), np.zeros((space.slots, space.dimensions), np.float32), zero, np.zeros(0), np.zeros(0), 0.5)
    idf = np.log((n + 1) / (held[1:] + 1)).astype(np.float32) + 0.1
    products = np.zeros((space.slots, space.slots))
    for row in rows.mapInArrow(_products(space, idf), "slot int, sums binary").toLocalIterator():
        products[row.slot] += np.frombuffer(row.sums)
    _, axes = np.linalg.eigh(products)
    axes = np.ascontiguousarray(axes[:, ::-1][:, : space.dimensions]).astype(np.float32)
    fields = [T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("vector", T.BinaryType())]
    short = rows.mapInArrow(_projected(space, idf, axes), T.StructType(fields)).toArrow().sort_by("doc_id")
    release(stored)
    vectors = np.frombuffer(b"".join(short["vector"].to_pylist()), np.float32).reshape(n, -1)
    label = np.asarray(short["label"]).astype(np.float64)
    taken = np.bincount(label.astype(int), minlength=2)
    share = np.array([sizes.get(k, 0) / max(taken[k], 1) for k in (0, 1)])
    weights = share[label.astype(int)]
    return Model(space, idf, axes, vectors, label, weights, float((weights * label).sum() / weights.sum()))


def _lowest(agreed: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """The ``most`` rows of each label whose ids hash lowest, ties by id.

    Hashes are even, so a bound on them that leaves some more than ``most`` of a label's rows
    is known from its size. Only rows below it are sorted, so no task sees a whole label.
    """
    hashed, parts = F.xxhash64("doc_id"), [agreed.where(F.lit(False))]
    for label, n in sizes.items():
        mine = agreed.where(F.col("label") == label)
        share = (most + 10 * most**0.5 + 100) / n
        if share < 1:
            below = mine.where(hashed < int(share * 2**64) - 2**63)
            mine = below if below.count() >= most else mine
        parts.append(mine.orderBy(hashed, "doc_id").limit(most))
    return reduce(DataFrame.unionByName, parts)


def vote(model: Model, texts: list[str]) -> np.ndarray:
    """The score of each text: the weighted share of label 1 among its nearest labelled texts.

    All texts as near as the last voter vote too, so ties need no order.
    """
    scores = np.full(len(texts), model.prior)
    full = [k for k, t in enumerate(texts) if t and not t.isspace()]
    if not full or not len(model.labels):
        return scores
    counts = term_counts([texts[k] for k in full], model.space)
    vectors = _unit(_weighted(counts, model.idf, model.space) @ model.axes)
    voters = min(model.space.voters, len(model.labels))
    for start in range(0, len(full), 256):
        near = np.round(vectors[start : start + 256] @ model.vectors.T, 5)
        last = np.partition(near, -voters, axis=1)[:, -voters]
        rows, columns = np.nonzero(near >= last[:, None])
        strength = np.maximum(near[rows, columns], 1e-3).astype(np.float64) ** model.space.power * model.weights[columns]
        total = np.bincount(rows, strength, minlength=len(near))
        scores[full[start : start + 256]] = np.bincount(rows, strength * model.labels[columns], minlength=len(near)) / total
    return scores


def scorer(spark, model: Model):
    """A column function from text to score, for use in any select or filter."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        one_thread()
        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(texts, type=pa.string()).fill_null("")], ["text"])
        parts = [vote(shared.value, part.column("text").to_pylist()) for part in text_batches([batch], chars=1_000_000)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return quality


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row; null, empty and blank texts get the prior."""
    source = id_and_text(docs, id_col, text_col)
    return source.select("doc_id", scorer(source.sparkSession, model)("text").alias("score"))


def accepted(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, each judged by its own text; all columns stay.

    Null, empty and blank texts get the model's prior, whatever their id; rows
    that repeat are judged alike. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    quality = scorer(docs.sparkSession, model)
    text = F.coalesce(f"c{place_of(docs, text_col)}", F.lit(""))
    return positioned(docs).where(quality(text) >= least).toDF(*docs.columns)
