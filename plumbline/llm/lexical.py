"""Ranked lexical search by Block-Max MaxScore over an inverted index in segments.

A segment holds the postings of a bounded number of texts, so one task builds
it and one task searches it, however large the table. Its lists are cut into
blocks of compressed document gaps and term frequencies; beside each block
stand its last document and the highest score part in it. The score parts need
the counts of all texts, so these are taken first.

A query goes through a segment's lists by falling bound. The lists read whole
are the essential ones: as soon as the bounds of all lists left sum to less
than the k-th best score known, no document outside those read can enter. The
remaining lists are only looked up: a candidate is rejected by the maxima of
the blocks it would be in before any of them is decompressed, and only blocks
of candidates that are left are. A task keeps its best per query over all its
segments, which raises the bar for the next; the tasks' heaps are merged by a
window at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.chosen_path import groups_in
from plumbline.llm.common import blocks_of, id_and_text, text_batches
from plumbline.llm.exact_dedup import _arrow_type
from plumbline.session import materialize, release, small_table

#: ASCII letters in lower case and digits stand for themselves, other ASCII for a gap; bytes beyond ASCII belong to words.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_PIECE = 1 << 22
#: Segments that one task searches, on average; it keeps its best over all of them.
SEGMENTS_PER_TASK = 4


@dataclass(frozen=True)
class Segments:
    """Most texts, terms and different terms of a segment (a longer text stands alone), and postings of a block."""

    texts: int = 1 << 16
    terms: int = 3_000_000
    vocabulary: int = 1_000_000
    block: int = 64


def _pieces(text: str) -> Iterator[bytes]:
    """The folded text in pieces of bounded size that end between words (a longer word is one piece)."""
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    start = 0
    while start < len(data):
        stop = start + _PIECE
        if stop < len(data):
            gap = data.find(b" ", stop)
            stop = len(data) if gap < 0 else gap
        yield data[start:stop]
        start = stop


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order."""
    return [t for piece in _pieces(text) for t in piece.split()]


def _count_terms(batches):
    for batch in text_batches(batches):
        lengths = []
        for text in batch.column("text").to_pylist():
            n = 0
            for piece in _pieces(text):
                word = np.frombuffer(piece, np.uint8) != 32
                n += int(word[0]) + int(np.count_nonzero(word[1:] & ~word[:-1]))
            lengths.append(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([sum(n > 0 for n in lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64())], ["texts", "terms"]
        )


def length_part(n: np.ndarray, texts: int, terms: int) -> np.ndarray:
    """How a text's length counts against it: 25 and three quarters of its share of the mean length, in percent."""
    return 25 + (75 * n.astype(np.int64) * texts) // terms


def score_part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A posting's score before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# --- compressed lists ---------------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers below 2**35 in 7-bit groups, the last below 128; and where each ends."""
    widths = np.ones(len(values), np.int64)
    for k in range(1, 5):
        widths += values >= 1 << (7 * k)
    ends = np.cumsum(widths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = widths > k
        more = np.where(widths[has] > k + 1, 128, 0)
        out[ends[has] - widths[has] + k] = (values[has] >> (7 * k)) & 127 | more
    return out.tobytes(), ends


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers of :func:`pack`."""
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    stops = np.flatnonzero(last)
    starts = np.r_[0, stops[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(starts, stops - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


class _Numbers(dict):
    """Terms numbered as they come."""

    def __missing__(self, term):
        self[term] = number = len(self)
        return number


#: What an index is written as: one row per segment and term, and one (``term`` null) for the segment's texts.
_LISTS = [
    ("segment", pa.int64()), ("term", pa.binary()), ("df", pa.int32()), ("lasts", pa.list_(pa.int32())), ("tops", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int32())), ("data", pa.binary()), ("parts", pa.list_(pa.int64())),
]


class _Segment:
    """Collects texts until the segment is full."""

    def __init__(self):
        self.ids, self.found, self.numbers, self.size = [], [], _Numbers(), 0

    def add(self, doc_id, text: str) -> None:
        for first, piece in enumerate(_pieces(text)):
            tokens = piece.split()
            if not tokens:
                continue
            new = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
            self.size += len(new)
            if first and self.ids and self.added:
                self.found[-1] = np.concatenate([self.found[-1], new])
            else:
                self.ids.append(doc_id)
                self.found.append(new)
                self.added = True
        self.added = False

    added = False

    def full(self, limits: Segments) -> bool:
        return len(self.ids) >= limits.texts or self.size >= limits.terms or len(self.numbers) >= limits.vocabulary

    def batches(self, segment: int, texts: int, terms: int, limits: Segments, schema: pa.Schema):
        """The segment's rows. Texts are numbered by id, so that equal scores are in order; terms are sorted."""
        ids = pa.array(self.ids, schema.field("ids").type.value_type)
        order = np.asarray(pc.sort_indices(ids))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lengths = np.array([len(x) for x in self.found], np.int64)
        parts = length_part(lengths[order], texts, terms)
        names = sorted(self.numbers)
        place = np.empty(len(names), np.int64)
        place[[self.numbers[t] for t in names]] = np.arange(len(names))
        keys = np.concatenate([(place[x] << 32) | r for x, r in zip(self.found, rank.tolist())])
        self.found = []
        keys, tf = np.unique(keys, return_counts=True)
        term, doc = keys >> 32, keys & 0xFFFFFFFF
        new_term = np.r_[True, term[1:] != term[:-1]]
        starts = np.flatnonzero(new_term)
        df = np.diff(np.r_[starts, len(term)])
        in_list = np.arange(len(term)) - np.repeat(starts, df)
        heads = np.flatnonzero(in_list % limits.block == 0)
        tails = np.r_[heads[1:], len(term)] - 1
        tops = np.maximum.reduceat(score_part(tf, parts[doc]), heads)
        before = np.where(new_term, -1, np.r_[-1, doc[:-1]])
        values = np.empty(2 * len(doc), np.int64)
        values[0::2], values[1::2] = doc - before - 1, tf - 1
        data, ends = pack(values)
        block_ends = ends[2 * tails + 1]
        list_ends = ends[2 * (starts + df) - 1]
        list_starts = np.r_[0, list_ends[:-1]]
        of = np.searchsorted(starts, heads, side="right") - 1
        blocks = np.r_[0, np.cumsum(np.bincount(of, minlength=len(starts)))].astype(np.int32)

        def lists(values):
            return pa.ListArray.from_arrays(pa.array(blocks), pa.array(values.astype(np.int32)))

        packed = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[list_starts, list_ends[-1:]].astype(np.int32).tobytes()), pa.py_buffer(data)])
        rows = {
            "segment": pa.array(np.full(len(starts), segment)), "term": pa.array(names, pa.binary()), "df": pa.array(df.astype(np.int32)),
            "lasts": lists(doc[tails]), "tops": lists(tops), "ends": lists(block_ends - list_starts[of]), "data": packed,
        }
        texts_row = {"segment": pa.array([segment]), "parts": pa.array([parts]), "ids": pa.array([ids.take(pa.array(order)).to_pylist()], schema.field("ids").type)}
        for columns, n in ((texts_row, 1), (rows, len(starts))):
            filled = pa.table([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema)
            yield from filled.to_batches(max_chunksize=5000)


def _build(texts: int, terms: int, limits: Segments, schema: pa.Schema):
    def run(batches):
        held, number = _Segment(), TaskContext.get().partitionId() << 32
        for batch in text_batches(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.add(doc_id, text)
                if held.full(limits):
                    yield from held.batches(number, texts, terms, limits, schema)
                    held, number = _Segment(), number + 1
        if held.size:
            yield from held.batches(number, texts, terms, limits, schema)

    return run


@dataclass
class Index:
    """An index written to the shared folder, with the number of texts that have a term and of all terms."""

    rows: DataFrame
    texts: int
    terms: int
    block: int

    def release(self) -> None:
        release(self.rows)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Segments = Segments()) -> Index:
    """Index every text of ``docs``. Null and empty texts have no terms and are never found."""
    source = id_and_text(docs, id_col, text_col)
    counted = source.select("doc_id", "text").mapInArrow(_count_terms, "texts long, terms long").agg(F.sum("texts"), F.sum("terms")).first()
    texts, terms = (int(x or 0) for x in counted)
    kind = source.schema["doc_id"].dataType
    schema = pa.schema([*_LISTS, ("ids", pa.list_(_arrow_type(kind)))])
    spark_type = "segment long, term binary, df int, lasts array<int>, tops array<int>, ends array<int>, data binary, parts array<long>"
    written = T.StructType([*T.StructType.fromDDL(spark_type), T.StructField("ids", T.ArrayType(kind))])
    return Index(materialize(source.mapInArrow(_build(texts, terms, limits, schema), written)), texts, terms, limits.block)


# --- search -------------------------------------------------------------------------------------


def weight(texts: int, df: int) -> int:
    """How much a term that ``df`` of ``texts`` texts have counts."""
    return math.floor(1000 * math.log((2 * texts + 2) / (2 * df + 1)))


@dataclass
class _List:
    """A term's list in a segment; nothing of ``data`` is decompressed before it is asked for."""

    lasts: np.ndarray
    tops: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    df: int
    parts: np.ndarray
    block: int

    def read(self, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Texts and score parts of the given blocks (ascending), or of all."""
        if blocks is None:
            values = unpack(self.data)
            doc, tf = np.cumsum(values[0::2] + 1) - 1, values[1::2] + 1
        else:
            begins = np.r_[0, self.ends[:-1]]
            values = unpack(np.concatenate([self.data[begins[b] : self.ends[b]] for b in blocks]))
            steps, tf = np.cumsum(values[0::2] + 1), values[1::2] + 1
            counts = np.minimum(self.block, self.df - blocks * self.block)
            heads = np.cumsum(counts) - counts
            base = np.where(blocks > 0, self.lasts[blocks - 1], -1) - np.r_[0, steps[heads[1:] - 1]]
            doc = steps + np.repeat(base, counts)
        return doc, score_part(tf, self.parts[doc])


def search_segment(lists: list[tuple[int, _List]], texts: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts and scores among which the segment's best ``k`` are, of those with a score of ``least`` (over 0) or more."""
    lists = sorted(((w * int(x.tops.max()), w, x) for w, x in lists), key=lambda t: -t[0])
    lists = [t for t in lists if t[0] > 0]
    left = np.r_[np.cumsum([t[0] for t in lists][::-1])[::-1], 0].astype(np.int64)
    scores = np.zeros(texts, np.int64)

    def bar(values):
        return max(least, int(np.partition(values, len(values) - k)[len(values) - k])) if len(values) >= k else least

    essential = 0
    while essential < len(lists) and left[essential] >= least:
        _, w, one = lists[essential]
        doc, part = one.read()
        scores[doc] += w * part
        essential += 1
        least = bar(scores)
    candidates = np.flatnonzero((scores > 0) & (scores + left[essential] >= least))
    known = scores[candidates]

    # Of the other lists only the blocks that candidates are in count, first by their maxima.
    rest, places, bound = lists[essential:], [], known.copy()
    for _, w, one in rest:
        place = np.searchsorted(one.lasts, candidates)
        places.append(place)
        bound += np.where(place < len(one.lasts), w * one.tops[np.minimum(place, len(one.lasts) - 1)].astype(np.int64), 0)
    keep = bound >= least
    for n, (_, w, one) in enumerate(rest):
        if not keep.all():
            candidates, known, bound, places = candidates[keep], known[keep], bound[keep], [p[keep] for p in places]
        if not len(candidates):
            break
        place = places[n]
        inside = place < len(one.lasts)
        gained = np.zeros(len(candidates), np.int64)
        if inside.any():
            blocks = np.unique(place[inside])
            doc, part = one.read(blocks)
            at = np.minimum(np.searchsorted(doc, candidates), len(doc) - 1)
            hit = inside & (doc[at] == candidates)
            gained[hit] = w * part[at[hit]]
            bound[inside] -= w * one.tops[place[inside]].astype(np.int64)
        known, bound = known + gained, bound + gained
        least = bar(known)
        keep = bound >= least
    keep = known >= least
    return candidates[keep], known[keep]


def _search(queries: list[list[tuple[int, int]]], k: int, block: int, kind: pa.DataType):
    """``queries`` has a list of (term number, weight) for each query."""

    def ordered(entry):
        return -entry[0], entry[1] is None, entry[1] if entry[1] is not None else 0

    def run(batches):
        best: list[list[tuple]] = [[] for _ in queries]
        for table in groups_in(batches, ["segment"]):
            numbers = np.asarray(table["number"])
            head = int(np.flatnonzero(numbers < 0)[0])
            parts, ids = np.asarray(table["parts"][head].values), table["ids"][head].values
            lists = {}
            for row in np.flatnonzero(numbers >= 0).tolist():
                lasts, tops, ends = (table[c][row].values.to_numpy() for c in ("lasts", "tops", "ends"))
                data = np.frombuffer(table["data"][row].as_buffer(), np.uint8)
                lists[int(numbers[row])] = _List(lasts, tops, ends, data, table["df"][row].as_py(), parts, block)
            for n, query in enumerate(queries):
                own = [(w, lists[t]) for t, w in query if t in lists]
                if own:
                    least = best[n][-1][0] if len(best[n]) == k else 1
                    doc, scores = search_segment(own, len(parts), k, least)
                    if len(doc):
                        first = np.lexsort((doc, -scores))[:k]
                        new = zip(scores[first].tolist(), ids.take(pa.array(doc[first])).to_pylist())
                        best[n] = sorted([*best[n], *new], key=ordered)[:k]
        rows = [(n, *entry) for n, entries in enumerate(best) for entry in entries]
        if rows:
            number, score, doc_id = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), pa.array(score, pa.int64()), pa.array(doc_id, kind)], ["number", "score", "doc_id"]
            )

    return run


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, k: int = 10, block_chars: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` texts of the highest score above 0 (all, if fewer).

    An item's terms count as often as it repeats them. Equal scores are ranked
    by ascending id, a null id last; rows that share id and score are ranked in
    any order, as nothing tells them apart. Items with a null or empty text, and
    terms that no text has, give nothing; items that repeat are answered each.
    Items are read and answered in blocks of ``block_chars`` characters.
    """
    spark = index.rows.sparkSession
    source = id_and_text(items, id_col, text_col)
    item_type = source.schema["doc_id"].dataType.simpleString()
    doc_type = index.rows.schema["ids"].dataType.elementType
    out = None
    for block, _ in blocks_of(source.toLocalIterator(), block_chars, lambda r: len(r.text)):
        found = _answer(index, [(r.doc_id, terms_of(r.text)) for r in block], item_type, doc_type, k)
        if found is not None:
            found = materialize(found)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type.simpleString()}, score long")
    return out


def _answer(index: Index, block: list[tuple], item_type: str, doc_type: T.DataType, k: int) -> DataFrame | None:
    spark = index.rows.sparkSession
    numbers: dict[bytes, int] = {}
    for _, terms in block:
        for term in terms:
            numbers.setdefault(term, len(numbers))
    if not numbers:
        return None
    wanted = F.broadcast(small_table(spark, [(t, n) for t, n in numbers.items()], "term binary, number int"))  # no more than the block's characters
    lists = index.rows.where("term IS NOT NULL").join(wanted, "term")
    df = {r.number: r.df for r in lists.groupBy("number").agg(F.sum("df").alias("df")).collect()}
    weights = {n: weight(index.texts, d) for n, d in df.items()}
    queries = [[(numbers[t], weights[numbers[t]] * c) for t, c in Counter(terms).items() if numbers[t] in weights] for _, terms in block]
    columns = ["segment", "number", "df", "lasts", "tops", "ends", "data", "parts", "ids"]
    heads = index.rows.where("term IS NULL").withColumn("number", F.lit(-1))
    # A task searches a few segments, whatever their number and the size of a shuffle partition.
    tasks = -(-heads.count() // SEGMENTS_PER_TASK) or 1
    rows = heads.select(*columns).unionByName(lists.select(*columns)).repartition(tasks, "segment").sortWithinPartitions("segment", "number")
    best = rows.mapInArrow(_search(queries, k, index.block, _arrow_type(doc_type)), f"number int, score long, doc_id {doc_type.simpleString()}")
    by_score = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    items = small_table(spark, [(n, i) for n, (i, _) in enumerate(block)], f"number int, item_id {item_type}")
    return ranked.join(F.broadcast(items), "number").select("item_id", "rank", "doc_id", "score")
