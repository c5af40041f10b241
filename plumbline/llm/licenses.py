"""Licence scans: Dice coefficient over word bigrams against licence templates.

Words are runs of letters and digits in lower case. Any run of words may be a
licence; only runs that start and end with a bigram of the template need a
look, as others gain by being cut. Of overlapping runs at or above the
threshold the best is taken first. A template that declares a licence by its
name only fits a run that holds the whole name, so that a run cut before
"version 1.1" does not pass for version 2.0. (A bare ``Scanner`` looks at runs
of whole clauses instead, cut at line ends and after . ! ? ; before white
space.) Two bags of bigrams of sizes a and b have a Dice
coefficient of t or more only if a lies between t / (2 - t) * b and
(2 - t) / t * b, so a template is compared only with runs within those bounds,
and only in texts that hold enough of its bigrams at all.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.characters import END, SPACE, mix, word_hashes
from plumbline.llm.common import id_and_text, text_batches
from plumbline.llm.license_templates import phrases, templates


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Letters and digits in lower case, all else as a space, for the first 65,536 characters."""
    table = np.full(1 << 16, SPACE, np.uint32)
    for number in range(1 << 16):
        character = chr(number)
        if character.isalnum():
            low = character.lower()
            table[number] = ord(low) if len(low) == 1 else number
    return table


def clause_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in order: hash, text number, clause number (over all texts), first and last place in its text."""
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    characters = np.where(raw < 1 << 16, _letters()[np.minimum(raw, (1 << 16) - 1)], raw)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    white = np.isin(raw, np.array([9, 10, 11, 12, 13, 32, 0], np.uint32))
    stop = np.isin(raw, np.array([ord(c) for c in ".!?;"], np.uint32))
    cut = (raw == 10) | (stop & np.r_[white[1:], True])
    characters[ends] = END
    cut[ends] = True
    hashes, starts = word_hashes(characters)
    clause = np.cumsum(cut)[starts]
    text = np.searchsorted(ends, starts)
    gap = np.flatnonzero((characters == SPACE) | (characters == END))
    last = gap[np.searchsorted(gap, starts)] if len(starts) else starts
    begin = np.r_[0, ends[:-1] + 1]
    return hashes, text, clause, starts - begin[text], last - begin[text]


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) if len(hashes) > 1 else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Template:
    licence: str
    bag: dict
    size: int
    needed: int
    whole: tuple = ()


class Scanner:
    """All templates, and the sorted bigrams of any of them.

    ``anywhere`` lets runs start and end at any word; ``phrases`` gives the
    words of a template (by its text) that a run must then hold unbroken.
    """

    def __init__(self, named_texts: list[tuple[str, str]], threshold: float, anywhere: bool = False, phrases: dict | None = None):
        self.threshold, self.templates, self.anywhere = threshold, [], anywhere
        for licence, text in named_texts:
            bag = Counter(_pairs(clause_words([text])[0]).tolist())
            size = sum(bag.values())
            if size:
                whole = {g for phrase in (phrases or {}).get(text, ()) for g in _pairs(clause_words([phrase])[0]).tolist()}
                self.templates.append(Template(licence, bag, size, int(np.ceil(threshold * size / (2 - threshold) - 1e-9)), tuple(sorted(whole))))
        self.every = np.unique(np.array([g for t in self.templates for g in t.bag], np.uint64))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.every >> np.uint64(44)).astype(np.int64)] = True
        self.fewest = min((t.needed for t in self.templates), default=0)
        self.holding: dict[int, list[int]] = {}
        for k, t in enumerate(self.templates):
            for gram in t.bag:
                self.holding.setdefault(gram, []).append(k)

    def scan(self, texts: list[str]) -> list[tuple]:
        """(text number, licence, dice, start, end) of the best run of each licence in each text; ``anywhere``, of every run."""
        hashes, text, clause, first, last = clause_words(texts)
        pairs = _pairs(hashes)
        if not len(pairs) or not self.templates:
            return []
        same = text[1:] == text[:-1]
        likely = np.flatnonzero(self.table[(pairs >> np.uint64(44)).astype(np.int64)] & same)
        spot = np.minimum(np.searchsorted(self.every, pairs[likely]), len(self.every) - 1)
        likely = likely[self.every[spot] == pairs[likely]]
        found = []
        counts = np.bincount(text[likely], minlength=len(texts))
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        for number in np.flatnonzero(counts >= self.fewest).tolist():
            a, b = int(bounds[number]), int(bounds[number + 1])
            own = likely[(likely >= a) & (likely < b)]
            if self.anywhere:
                found += ((number, licence, dice, int(first[p]), int(last[q])) for licence, dice, p, q in self._runs(pairs, own))
            else:
                found += ((number, *hit) for hit in self._of_text(pairs, clause, first, last, a, b, own))
        return found

    def _runs(self, pairs: np.ndarray, hits: np.ndarray) -> list[tuple]:
        """licence, dice, first and last word of every run, the best first wherever some overlap; by place."""
        grams = pairs[hits]
        kinds, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
        shared: Counter = Counter()
        holders: dict[int, list[int]] = {}
        for kind, (gram, n) in enumerate(zip(kinds.tolist(), counts.tolist())):
            for k in self.holding[gram]:
                shared[k] += min(n, self.templates[k].bag[gram])
                holders.setdefault(k, []).append(kind)
        order = np.argsort(inverse, kind="stable")
        begins = np.cumsum(counts) - counts
        parts = []
        for k, n in shared.items():
            template = self.templates[k]
            if n < template.needed or not all(gram in kinds for gram in template.whole):
                continue
            own = np.sort(np.concatenate([order[begins[x] : begins[x] + counts[x]] for x in holders[k]]))
            parts += [(k, *columns) for columns in self._of_template(template, hits[own], grams[own])]
        if not parts:
            return []
        dice, start, end, both = (np.concatenate([p[c] for p in parts]) for c in (1, 2, 3, 4))
        which = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        names = sorted({t.licence for t in self.templates})
        rank = np.array([names.index(t.licence) for t in self.templates])[which]
        found = []
        # Runs compete only within their cluster of overlapping ones.
        by_start = np.argsort(start, kind="stable")
        reach = np.maximum.accumulate(end[by_start])
        for cluster in np.split(by_start, np.flatnonzero(start[by_start][1:] > reach[:-1]) + 1):
            cluster = cluster[np.lexsort((rank[cluster], start[cluster], -both[cluster], -dice[cluster]))]
            while len(cluster):
                one = cluster[0]
                found.append((int(start[one]), int(end[one]), names[rank[one]], float(dice[one])))
                cluster = cluster[(end[cluster] < start[one]) | (start[cluster] > end[one])]
        return [(licence, value, p, q) for p, q, licence, value in sorted(found)]

    def _of_template(self, template: Template, places: np.ndarray, grams: np.ndarray):
        """dice, first word, last word, shared bigrams of all runs at or above the threshold, in pieces of bounded size.

        ``places`` are those of the template's bigrams. A run is given by its
        first and its last; between them, a bigram counts as often as the
        template has it.
        """
        t, n = self.threshold, len(places)
        most = int(np.floor((2 - t) / t * template.size + 1e-9))
        ahead = template.needed - 1  # a run from a place holds at least so many more
        firsts = np.arange(max(n - ahead, 0))
        firsts = firsts[places[firsts + ahead] - places[firsts] < most]
        if not len(firsts):
            return
        # The place where the bigram before last within the template's number of them stands: beyond it, one more does not count.
        previous = np.full(n, -1)
        seen: dict[int, list[int]] = {}
        for h, gram in enumerate(grams.tolist()):
            at = seen.setdefault(gram, [])
            if len(at) >= template.bag[gram]:
                previous[h] = at[-template.bag[gram]]
            at.append(h)
        lasts = np.searchsorted(places, places[firsts] + most) - 1
        # From each place on, the first one by which all of the phrases' bigrams were seen.
        complete = firsts.copy()
        for gram in template.whole:
            at = np.append(seen.get(gram, []), n).astype(np.int64)
            complete = np.maximum(complete, at[np.searchsorted(at, firsts)])
        band = int((lasts - firsts).max()) + 1
        step = max(1, 1_000_000 // band)
        for a in range(0, len(firsts), step):
            rows = firsts[a : a + step, None]
            ends = rows + np.arange(band)
            inside = ends <= lasts[a : a + step, None]
            ends = np.minimum(ends, n - 1)
            both = np.cumsum(inside & (previous[ends] < rows), axis=1)
            size = places[ends] - places[rows] + 1
            dice = 2 * both / (size + template.size)
            x, y = np.nonzero(inside & (ends >= complete[a : a + step, None]) & (dice >= t - 1e-9))
            if len(x):
                yield dice[x, y], places[rows[x, 0]], places[ends[x, y]] + 1, both[x, y]

    def _of_text(self, pairs, clause, first, last, a: int, b: int, hits: np.ndarray):
        grams = pairs[hits].tolist()
        shared: Counter = Counter()
        for gram, n in Counter(grams).items():
            for k in self.holding[gram]:
                shared[k] += min(n, self.templates[k].bag[gram])
        # Words of each clause; a run of clauses from word p up to word q has the bigrams p .. q - 2.
        begins = a + np.flatnonzero(np.r_[True, np.diff(clause[a:b]) != 0])
        ends = np.r_[begins[1:], b]
        best: dict[str, tuple] = {}
        for k, n in shared.items():
            template = self.templates[k]
            if n < template.needed:
                continue
            t = self.threshold
            most = int(np.floor((2 - t) / t * template.size + 1e-9))
            own = np.array([h for h, g in zip(hits.tolist(), grams) if g in template.bag])
            # A run starts in the clause of a shared bigram's first word and ends in that of a shared bigram's second.
            starts = np.unique(np.searchsorted(begins, own, side="right") - 1)
            stops = np.unique(np.searchsorted(begins, own + 1, side="right") - 1)
            for s in starts.tolist():
                p = int(begins[s])
                for e in stops[np.searchsorted(stops, s) :].tolist():
                    q = int(ends[e])
                    size = q - p - 1
                    if size > most:
                        break
                    low, high = np.searchsorted(own, [p, q - 1])
                    if high - low < t * (size + template.size) / 2 - 1e-9:
                        continue
                    inside = Counter(pairs[own[low:high]].tolist())
                    both = sum(min(c, template.bag[g]) for g, c in inside.items())
                    dice = 2 * both / (size + template.size)
                    if dice >= t - 1e-9:
                        value = (-dice, int(first[p]), int(last[q - 1]))
                        if template.licence not in best or value < best[template.licence]:
                            best[template.licence] = value
        # Licences with like wording compete for a place: the best run wins, then the first by name.
        taken: list[tuple[int, int]] = []
        for (negative, start, end), licence in sorted((value, licence) for licence, value in best.items()):
            if all(end <= x or start >= y for x, y in taken):
                taken.append((start, end))
                yield licence, -negative, start, end


@lru_cache(maxsize=4)
def _scanner(threshold: float) -> Scanner:
    return Scanner(templates(), threshold, True, phrases())


def find_licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.85,
    named_texts: list[tuple[str, str]] | None = None,
    every: bool = False,
) -> DataFrame:
    """doc_id, licence, dice, start, end: the best run of every licence that a text holds; start and end in code points.

    Runs of words that overlap compete: the best is taken first, of equally
    good ones the one that shares more, then the first, then by name; what
    overlaps a taken one is left out. With ``every``, all runs taken are
    given, otherwise the best of each licence among them, then the first.

    ``named_texts`` are (licence, text) pairs instead of the built-in
    templates; templates of fewer than two words match nothing. Null and empty texts hold
    none and do not appear; repeated rows are each reported.
    """
    source = id_and_text(docs, id_col, text_col)
    own = named_texts

    def run(batches):
        scanner = _scanner(threshold) if own is None else Scanner(own, threshold, True)
        for batch in text_batches(batches, chars=1_000_000):
            rows = scanner.scan(batch.column("text").to_pylist())
            if not every:
                best: dict[tuple, tuple] = {}
                for row in rows:
                    if row[:2] not in best or row[2] > best[row[:2]][2]:
                        best[row[:2]] = row
                rows = list(best.values())
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([r[0] for r in rows])),
                        pa.array([r[1] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.float64()),
                        pa.array([r[3] for r in rows], pa.int64()),
                        pa.array([r[4] for r in rows], pa.int64()),
                    ],
                    ["doc_id", "licence", "dice", "start", "end"],
                )

    return source.mapInArrow(
        run,
        T.StructType(
            [
                T.StructField("doc_id", source.schema["doc_id"].dataType),
                T.StructField("licence", T.StringType()),
                T.StructField("dice", T.DoubleType()),
                T.StructField("start", T.LongType()),
                T.StructField("end", T.LongType()),
            ]
        ),
    )
