import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(docs, items, k=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    texts, terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * texts) // terms
            s = sum(
                math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in plain_terms(text)
                if t in c
            )
            if s > 0:
                scored.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "item_id bigint, text string, segment string")


def invented(rng, n, words):
    names = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return [(k, " ".join(rng.choices(names, weights, k=rng.choice([3, 20, 80, 300])))) for k in range(n)]


def test_numbers_round_trip():
    rng = np.random.default_rng(1)
    for limit in (2, 128, 129, 1 << 20, 1 << 34):
        values = rng.integers(0, limit, 500)
        data, ends = L.pack(values)
        assert np.array_equal(L.unpack(np.frombuffer(data, np.uint8)), values) and ends[-1] == len(data)


def test_terms_of_odd_texts(monkeypatch):
    rng = random.Random(2)
    alphabet = ["a", "B", "Z", "é", "É", "7", " ", " ", "\x7f", "\x85", " ", "_", "-", "\n", "漢", "🙂", "@"]
    for size in (1 << 22, 7):
        monkeypatch.setattr(L, "_PIECE", size)
        for _ in range(200):
            text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
            assert L.terms_of(text) == [t.encode() for t in plain_terms(text)]


@pytest.mark.parametrize("limits", [L.Segments(), L.Segments(texts=50, block=4), L.Segments(terms=500, vocabulary=30, block=2)])
def test_equals_brute_force(spark, table, limits):
    rng = random.Random(3)
    docs = invented(rng, 600, 200)
    docs += [(1000 + k, docs[k % 7][1]) for k in range(150)]  # equal scores
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices([f"w{j}" for j in range(230)], k=rng.choice([1, 5, 40])))) for k in range(40)]
    index = L.build_index(table(docs).repartition(3), limits=limits)
    want = brute(docs, items)
    assert got(L.search(index, items_of(spark, items))) == want
    assert got(L.search(index, items_of(spark, items), block_chars=300)) == want
    index.release()


def test_hard_cases(spark, hard):
    docs = [(r.doc_id, r.text) for r in hard.collect()]
    items = [(1, "one TWO two one"), (2, None), (3, ""), (3, "nothingness"), (None, "a ID"), (5, "word7 word7 word9"), (5, "é漢字🙂"), (5, "é漢字🙂")]
    assert got(L.search(L.build_index(hard), items_of(spark, items))) == brute(docs, items)


def test_piecewise_texts_count_as_one(spark, table, monkeypatch):
    held = L._Segment()
    monkeypatch.setattr(L, "_PIECE", 5)
    for k, text in enumerate(["a bb ccc dddd eeeee", "", " - ", "a a"]):
        held.add(k, text)
    assert held.ids == [0, 3] and [len(x) for x in held.found] == [5, 2]


def test_empty_tables(spark, nothing, table):
    items = items_of(spark, [(1, "a b")])
    assert L.search(L.build_index(nothing), items).count() == 0
    assert L.search(L.build_index(table([(1, None), (2, " - ")])), items).count() == 0
    assert L.search(L.build_index(table([(1, "a")])), items_of(spark, [])).count() == 0


def test_blocks_are_rejected_before_they_are_decompressed(monkeypatch):
    """One short text has the rare term; of the frequent term's list only its block is read."""
    texts = 6400
    parts = np.full(texts, 100, np.int64)

    def one(docs):
        docs = np.array(docs, np.int64)
        values = np.empty(2 * len(docs), np.int64)
        values[0::2], values[1::2] = np.diff(np.r_[-1, docs]) - 1, 0
        data, ends = L.pack(values)
        heads = np.arange(0, len(docs), 64)
        tails = np.r_[heads[1:], len(docs)] - 1
        tops = np.maximum.reduceat(L.score_part(np.ones(len(docs), np.int64), parts[docs]), heads)
        return L._List(docs[tails], tops, ends[2 * tails + 1], np.frombuffer(data, np.uint8), len(docs), parts, 64)

    read, real = [], L._List.read
    monkeypatch.setattr(L._List, "read", lambda self, blocks=None: read.append((self.df, None if blocks is None else blocks.tolist())) or real(self, blocks))
    doc, scores = L.search_segment([(9000, one([3000])), (5, one(range(texts)))], texts, 1, 1)
    assert doc.tolist() == [3000] and read == [(1, None), (texts, [46])]
