import random
import re
from itertools import combinations

import xxhash

from plumbline.llm import simhash as S


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(prints):
    """Per position: the smallest position that links of at most 2 bits reach."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = smallest_reachable(prints)
    ids = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            ids[r] = min(i, ids.get(r, i))
    return sorted(((i, f"{p:016x}", ids.get(r)) for (i, _), p, r in zip(rows, prints, roots)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_every_pair_within_the_radius_agrees_in_some_table():
    tables = S.masks()
    assert len(tables) == 7
    for places in combinations(range(64), 2):
        bits = sum(1 << p for p in places)
        assert any(m & bits == 0 for m in tables)
    looked_at = [(m & (1 << 64) - 1).bit_count() for m in tables]
    assert max(looked_at) - min(looked_at) <= 1


def test_wider_radius_is_covered():
    tables, rng = S.masks(4), random.Random(1)
    assert len(tables) == 31
    for _ in range(3000):
        bits = sum(1 << p for p in rng.sample(range(64), 4))
        assert any(m & bits == 0 for m in tables)


def test_hard_cases(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert got(S.near_copies(hard)) == brute(rows)


def test_fingerprints_of_odd_texts():
    rng = random.Random(2)
    alphabet = ["a", "B", "Z", "é", "É", " ", " ", "\x1c", "\x85", " ", "\t", "\x0b", "\n", "漢", "🙂", "."]
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        assert S.fingerprint(text) == plain_fingerprint(text)


def test_long_text_is_counted_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 71}" for k in range(3000))
    monkeypatch.setattr(S, "_PIECE", 100)
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_near_copies_and_chains(table):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(30):
        base = rng.choices(words, k=200)
        for _ in range(5):
            new = list(base)
            for _ in range(rng.randrange(4)):
                new[rng.randrange(200)] = rng.choice(words)
            rows.append((len(rows), " ".join(new)))
    want = brute(rows)
    assert len({r[2] for r in want}) < len(rows)
    assert got(S.near_copies(table(rows))) == want


def test_links_of_planted_fingerprints(spark):
    """Dense families, chains two bits apart and distances of three, against all pairs."""
    rng = random.Random(4)
    prints = set()
    for _ in range(20):
        at = rng.getrandbits(64)
        prints.add(at)
        for _ in range(12):
            at ^= sum(1 << p for p in rng.sample(range(64), rng.choice([1, 2, 3])))
            prints.add(at)
    dense = rng.getrandbits(64)
    prints |= {dense ^ (x << 40) for x in range(512)}
    prints = sorted(S._signed(p) for p in prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    roots = {r.node: r.root for r in S.components(S.links(frame)).collect()}
    want = smallest_reachable([p & (1 << 64) - 1 for p in prints])
    assert [roots.get(p, p) for p in prints] == [prints[k] for k in want]


def test_rows_grow_with_a_family_in_proportion(spark):
    """A family of m fingerprints in one bucket gives at most 64 edges each, not m."""
    for m in (256, 2048):
        frame = spark.range(m).selectExpr("shiftleft(id, 20) AS fingerprint")
        assert S.links(frame).count() <= 65 * m


def test_empty_table(nothing):
    assert S.near_copies(nothing).count() == 0
