"""Benchmark passages in texts, by the q-gram lemma and banded alignment.

A text region within ``e`` edits of a passage of ``m`` characters shares at
least ``m - q + 1 - q * e`` q-grams with it, all on ``e + 1`` neighbouring
diagonals (place in the text minus place in the passage). Shared q-grams are
counted in bands of ``e + 1`` diagonals, two neighbouring bands taken together,
so that every such run of diagonals lies in one of the overlapping pairs.
Regions that meet the bound are aligned with the passage in that band.
Passages too short for the lemma are searched verbatim, between word borders,
in the same pass.

The passages are the query set. They are packed into blocks of bounded size;
each block is broadcast and meets all texts in one pass that moves no text.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.characters import END, fold
from plumbline.llm.common import blocks_of, id_and_text, picked, text_batches
from plumbline.session import materialize

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Lemma:
    """q-gram length, edits allowed per passage character, shortest passage that is searched with edits (in characters).

    The budget is the rate's or, for passages of fewer than about q / (1 - q * rate) characters more
    (below 80 with the defaults), what the lemma can bound: (m - q) // q.
    """

    q: int = 8
    edit_rate: float = 0.10
    min_chars: int = 30

    def edits(self, m: int) -> int:
        """The edit budget of a passage: its share, but no more than the lemma can bound."""
        return max(0, min(int(self.edit_rate * m), (m - self.q) // self.q))

    def shared(self, m: int) -> int:
        return m - self.q + 1 - self.q * self.edits(m)


def gram_hashes(characters: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, joined from hashes of halves."""
    done, length, pending = characters.astype(np.uint64) * _MIX, 1, None
    tail, tail_length, rest = None, 0, q
    while True:
        if rest & 1:
            if tail is None:
                tail, tail_length = done, length
            else:
                n = len(tail) - length
                tail, tail_length = (done[: max(n, 0)] * _MIX ^ (done[: max(n, 0)] >> np.uint64(29))) + tail[length : length + max(n, 0)], tail_length + length
        rest >>= 1
        if not rest:
            break
        n = max(len(done) - length, 0)
        done, length = (done[:n] * _MIX ^ (done[:n] >> np.uint64(29))) + done[length : length + n], length * 2
    return tail[: max(len(characters) - q + 1, 0)]


#: Neighbouring bands that are aligned at once; in texts of repeats all of a text's may meet the bound.
_BANDS = 256


def _parts(runs):
    """``runs``, each in parts of at most ``_BANDS``."""
    return ((run, run[k : k + _BANDS]) for run in runs for k in range(0, len(run), _BANDS))


def _as_text(characters: np.ndarray) -> str:
    """Folded characters as text, with NUL for the ends."""
    return np.where(characters == END, np.uint32(0), characters).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


class PassageIndex:
    """The q-grams of a block of passages with their places, and a small table that most other q-grams fail."""

    def __init__(self, items: list[tuple], lemma: Lemma):
        self.lemma, self.ids, self.passages = lemma, [], []
        self.short_ids, self.short = [], ahocorasick.Automaton()
        for item_id, text in items:
            characters = fold([text.strip()])[0][:-1]
            if len(characters) >= max(lemma.min_chars, lemma.q):
                self.ids.append(item_id)
                self.passages.append(characters)
            elif len(characters):
                word = _as_text(characters)
                self.short.add_word(word, (*self.short.get(word, ()), len(self.short_ids)))
                self.short_ids.append(item_id)
        if len(self.short):
            self.short.make_automaton()
        sizes = np.array([len(p) for p in self.passages], np.int64)
        self.edits = np.array([lemma.edits(int(m)) for m in sizes], np.int64)
        self.bounds = np.array([lemma.shared(int(m)) for m in sizes], np.int64)
        self.sizes = sizes
        hashes = [gram_hashes(p, lemma.q) for p in self.passages]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.grams, self.starts, self.counts = np.unique(every[order], return_index=True, return_counts=True)
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.table_bits = max(16, min(26, int(np.ceil(np.log2(max(len(self.grams), 1)))) + 6))
        self.table = np.zeros(1 << self.table_bits, bool)
        self.table[self._slot(self.grams)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * _MIX) >> np.uint64(64 - self.table_bits)

    def search(self, texts: list[str]) -> list[tuple]:
        """(text number, item, start, end, edits, shared q-grams) of every passage found, the best region of each."""
        if not self.passages and not self.short_ids:
            return []
        characters, places = fold(texts)
        stops = np.flatnonzero(characters == END)
        short = self._search_short(characters, places, stops) if self.short_ids else []
        return short + (self._search_long(characters, places, stops) if self.passages else [])

    def _search_short(self, characters, places, stops) -> list[tuple]:
        """The first place of every short passage in every text where it stands as it is, its ends no part of longer words."""
        joined, found = _as_text(characters), {}
        for last, entries in self.short.iter(joined):
            for one in entries:
                length = self._short_sizes()[one]
                first = last + 1 - length
                number = int(np.searchsorted(stops, first))
                inside = last < stops[number]
                before = joined[first - 1 : first] if first else ""
                after = joined[last + 1 : last + 2]
                cut = joined[first].isalnum() and before.isalnum() or joined[last].isalnum() and after.isalnum()
                if inside and not cut and (number, one) not in found:
                    start = int(places[stops[number - 1] + 1]) if number else 0
                    shared = max(0, length - self.lemma.q + 1)
                    found[number, one] = (number, self.short_ids[one], int(places[first]) - start, int(places[last]) + 1 - start, 0, shared)
        return list(found.values())

    def _short_sizes(self) -> dict[int, int]:
        if not hasattr(self, "_sizes"):
            self._sizes = {one: len(word) for word, entries in self.short.items() for one in entries}
        return self._sizes

    def _search_long(self, characters, places, stops) -> list[tuple]:
        begins = np.concatenate([[0], stops[:-1] + 1])
        hashes = gram_hashes(characters, self.lemma.q)
        hits = np.flatnonzero(self.table[self._slot(hashes)])
        found = np.searchsorted(self.grams, hashes[hits])
        found[found == len(self.grams)] = 0
        real = self.grams[found] == hashes[hits]
        hits, found = hits[real], found[real]
        # A region that can meet the bound holds so many hits within its length; q-grams over an end never are hits.
        least, longest = int(self.bounds.min()), int((self.sizes + 2 * self.edits).max())
        if len(hits) < least:
            return []
        close = hits[least - 1 :] - hits[: len(hits) - least + 1] <= longest
        cover = np.zeros(len(hits) + 1, np.int64)
        cover[: len(close)] += close
        cover[least : least + len(close)] -= close
        dense = np.cumsum(cover)[:-1] > 0
        hits, found = hits[dense], found[dense]
        if not len(hits):
            return []
        counts = self.counts[found]
        rows = np.repeat(np.arange(len(hits)), counts)
        entry = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.starts[found], counts)
        item, diagonal = self.item[entry].astype(np.int64), hits[rows] - self.place[entry]
        text = np.searchsorted(stops, hits[rows])
        # Bands of e + 1 diagonals, counted from before the batch so that numbers stay positive.
        band = (diagonal + longest) // (self.edits[item] + 1)
        width = int(band.max()) + 2
        keys, inverse, sums = np.unique((text * len(self.ids) + item) * width + band, return_inverse=True, return_counts=True)
        paired = sums.copy()
        paired[:-1] += np.where(keys[1:] == keys[:-1] + 1, sums[1:], 0)
        good = np.flatnonzero(paired >= self.bounds[(keys // width) % len(self.ids)])
        best: dict[tuple[int, int], tuple] = {}
        for whole, run in _parts(np.split(good, np.flatnonzero(np.diff(keys[good]) > 1) + 1) if len(good) else []):
            key = int(keys[run[0]])
            number, one = divmod(key // width, len(self.ids))
            step = int(self.edits[one]) + 1
            low = (key % width) * step - longest
            high = (int(keys[run[-1]]) % width + 2) * step - 1 - longest
            shared = int(paired[whole].max())
            start, end = int(begins[number]), int(stops[number])
            hit = self._align(characters, one, low, high, start, end)
            if hit is not None:
                edits, a, b = hit
                value = (edits, int(places[a] - places[start]), int(places[b - 1] - places[start]) + 1, shared)
                kept = best.get((number, one))
                if kept is None or value[:2] < kept[:2]:
                    best[number, one] = value
        return [(number, self.ids[one], a, b, edits, shared) for (number, one), (edits, a, b, shared) in best.items()]

    def _align(self, characters, one: int, low: int, high: int, start: int, end: int):
        """Fewest edits of the passage against a region on the diagonals low..high (e more on both sides), or None."""
        passage, budget = self.passages[one], int(self.edits[one])
        m = len(passage)
        low, high = low - budget, high + budget
        for diagonal in range(max(low, start), min(high, end - m) + 1):  # verbatim
            if characters[diagonal] == passage[0] and np.array_equal(characters[diagonal : diagonal + m], passage):
                return 0, diagonal, diagonal + m
        width = high - low + 1
        region = np.full(m + width, END, np.uint32)
        a, b = max(low, start), min(low + m + width, end)
        if b <= a:
            return None
        region[a - low : b - low] = characters[a:b]
        # One number holds the edits and, below them, where the region starts.
        unit = 1 << 20
        lanes = np.arange(width, dtype=np.int64)
        insert = lanes * unit
        row = lanes.copy()
        row[(lanes + low < start) | (lanes + low > end)] = unit * (m + 1)
        for i in range(m):
            text = region[i : i + width]
            step = row + np.where(text == passage[i], 0, unit)
            step[:-1] = np.minimum(step[:-1], row[1:] + unit)
            row = np.minimum.accumulate(step - insert) + insert
        inside = lanes + low + m
        row[(inside > end) | (inside < start)] = unit * (m + 1)
        lane = int(np.argmin(row))
        edits, first = divmod(int(row[lane]), unit)
        return (edits, low + first, low + lane + m) if edits <= budget and lane + m > first else None


def find_passages(
    docs: DataFrame,
    passages: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "text",
    *,
    lemma: Lemma = Lemma(),
    block_chars: int = 2_000_000,
) -> DataFrame:
    """doc_id, item_id, start, end, edits, shared_grams: the passages that texts hold, the best region of each pair.

    Letters are compared in lower case and white space runs as one space;
    start and end count code points of the text as given. A passage may have
    ``lemma.edit_rate`` of its length in edits (see ``Lemma`` for the lower budget of
    short ones), one of fewer than ``lemma.min_chars`` none, and its ends must not
    cut a word. Null, empty and blank passages are in no text; null and empty texts
    hold none. Equal passages and repeated rows are each reported. Rows
    without a passage do not appear.
    """
    source = id_and_text(docs, id_col, text_col)
    spark = source.sparkSession
    items = picked(passages, i=item_col, t=passage_col).where("t IS NOT NULL")
    id_field = T.StructField("doc_id", source.schema["doc_id"].dataType)
    item_field = T.StructField("item_id", items.schema["i"].dataType)
    schema = T.StructType([id_field, item_field, *(T.StructField(n, T.LongType()) for n in ("start", "end", "edits", "shared_grams"))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def searcher(index):
        def run(batches):
            for batch in text_batches(batches, chars=1_000_000):
                rows = index.value.search(batch.column("text").to_pylist())
                if rows:
                    ids = batch.column("doc_id").take(pa.array([r[0] for r in rows]))
                    columns = [ids.cast(arrow[0].type), *(pa.array([r[k] for r in rows], arrow[k].type) for k in range(1, 6))]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        return run

    found = []
    blocks = blocks_of(((r.i, r.t) for r in items.toLocalIterator()), block_chars, lambda item: len(item[1]))
    for block, last in blocks:  # a block's result is written before the next is read
        index = spark.sparkContext.broadcast(PassageIndex(block, lemma))
        result = source.mapInArrow(searcher(index), schema)
        found.append(materialize(result) if found or not last else result)
    if not found:
        return spark.createDataFrame([], schema)
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result
