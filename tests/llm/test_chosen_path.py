import random

import numpy as np
import pytest

from plumbline.llm import chosen_path as C
from plumbline.llm.characters import shingle_sets


def brute(rows, threshold=0.8):
    """class_id, copy_id, n_copies, n_links by comparing all sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        s = frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])
        sets.setdefault(s, []).append(i)
    names = list(sets)
    small = {s: min((i for i in ids if i is not None), default=None) for s, ids in sets.items()}
    linked = {s: [] for s in names}
    for k, a in enumerate(names):
        for b in names[:k]:
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                linked[a].append(b)
                linked[b].append(a)
    out = {}
    for s in names:
        seen, todo = {s}, [s]
        while todo:
            for other in linked[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        ids = [small[x] for x in seen if small[x] is not None]
        out[s] = (min(ids) if ids else None, small[s], len(sets[s]), len(linked[s]))
    return sorted(((i, *out[s]) for s, ids in sets.items() for i in ids), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def families(seed, groups, members, words=120, edits=4):
    rng = random.Random(seed)
    rows, common = [], " ".join(f"boiler{k}" for k in range(12))
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(members):
            text = base[:]
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text) + (" " + common if rng.random() < 0.5 else "")))
    return rows


def test_families_equal_brute_force(table):
    rows = families(1, 25, 6)
    assert got(C.near_duplicates(table(rows))) == brute(rows)


def test_one_large_family_is_split_and_blocked(table):
    """Small leaves and blocks: the same links as in one bucket."""
    rows = families(2, 1, 90, edits=6) + [(1000 + i, t) for i, t in families(3, 10, 2)]
    options = C.Paths(leaf=8, block=16, depth=3)
    assert got(C.near_duplicates(table(rows), options=options)) == brute(rows)


def test_hard_cases(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert got(C.near_duplicates(hard)) == brute(rows)


def test_one_of_each(hard):
    kept = C.one_of_each(hard)
    assert kept.columns == hard.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 4, 5, 5, 6, 8]


def test_empty_table_and_table_without_words(nothing, table):
    assert C.near_duplicates(nothing).count() == 0
    assert got(C.near_duplicates(table([(1, ""), (2, None)]))) == [(1, 1, 1, 2, 0), (2, 1, 1, 2, 0)]


def test_overlaps_equal_set_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(20)]
    both = C.overlaps(sets, columns=16)
    assert all(both[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(20) for j in range(20) if i != j)


def test_minhash_agreement_estimates_jaccard():
    texts = [" ".join(map(str, range(0, 1000))), " ".join(map(str, range(100, 1100)))]
    sets = shingle_sets(texts)
    tokens = C.min_tokens(sets, 128)
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs((tokens[0] == tokens[1]).mean() - true) < 0.15


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(101, 100)], "node bigint, root bigint")
    assert {r.node: r.root for r in C.components(edges).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("words", [1, 5])
def test_shingles_of_short_texts(words):
    one, two, none, three = shingle_sets(["A b", "a  B\n", " ", "a c"], words)
    assert np.array_equal(one, two) and len(none) == 0 and not np.array_equal(one, three)


def frequent_lines(seed, pairs, pool=60, lines=20, words=30):
    """Pairs of documents made of lines that many documents have; the second has another line in the place of one."""
    rng, rows = random.Random(seed), []
    texts = [" ".join(f"l{k}w{i}" for i in range(words)) for k in range(pool)]
    for _ in range(pairs):
        chosen = sorted(rng.sample(range(pool), lines))
        other = chosen[:]
        other[rng.randrange(lines)] = rng.choice([k for k in range(pool) if k not in chosen])
        rows += [" ".join(texts[k] for k in own) for own in (chosen, other)]
    return rows


def test_deep_pairs_beside_a_large_family(table):
    """The easy links of the family do not hide those that are missed deep down."""
    rows = list(enumerate(frequent_lines(4, 150) + [t for _, t in families(2, 1, 120, edits=6)]))
    options = C.Paths(leaf=4, runs=4, family=8)
    assert got(C.near_duplicates(table(rows), options=options)) == brute(rows)


def test_estimate_counts_runs_not_buckets():
    import pyarrow as pa

    table = pa.table({"leaves": [[1, 2, 3], [1, 2, 3], [3]], "runs": pa.array([[[0], [0], [0, 4]], [[0], [0], [0, 4]], [[0, 4]]], pa.list_(pa.list_(pa.int32())))})
    names, first, held = C._held(table)
    assert C._runs_met(table, first, held).tolist() == [[2, 2, 2]] * 3
    assert C._earlier(names, held, 3).tolist() == [[True, True, False], [True, True, False], [False, False, False]]
    assert C.reached(1000, 20, 60, 0.995) and not C.reached(1000, 160, 266, 0.995)


def test_run_numbers_beyond_a_byte():
    tokens = C.min_tokens([np.arange(50, dtype=np.uint64)], 128)
    for number in (0, 127, 160, C._MOST_RUNS - 1):
        _, paths = C.chosen(np.repeat(tokens, 20, axis=0), np.full(20, number << C._RUN_BITS, np.int64), 0.8)
        assert (paths >> C._RUN_BITS == number).all() and (paths >= 0).all()


def test_large_families_in_tiles_and_blocks(table, monkeypatch):
    """A family in which a part of all pairs is linked, compared in one block, in tiles, or in several blocks."""
    rng = random.Random(21)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(420):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = f"x{rng.randrange(4)}"
        rows.append((k, " ".join(words)))
    want = brute(rows)
    for options in (C.Paths(), C.Paths(block=100), C.Paths(block_shingles=6000)):
        assert got(C.near_duplicates(table(rows), options=options)) == want


def test_overlaps_equal_brute_force():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 400))).astype(np.uint64) for _ in range(300)]
    found = C.Overlaps(sets)
    whole = np.concatenate([found.of(a, b) for a, b in C._tiles(300)])
    assert all(whole[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(0, 300, 7) for j in range(0, 300, 11))
