import random
import re

import numpy as np

from plumbline.llm import decontaminate as D


def distance(passage, text):
    """Fewest edits of the passage against any part of the text, by plain dynamic programming."""
    row = np.zeros(len(text) + 1, int)
    for i, p in enumerate(passage, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, t in enumerate(text, 1):
            new[j] = min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1)
        row = new
    return row.min()


def edited(rng, text, n):
    letters = list(text)
    for _ in range(n):
        k = rng.randrange(len(letters))
        letters[k : k + 1] = rng.choice([[], ["#"], [letters[k], "#"]])
    return "".join(letters)


def test_equals_brute_force_on_edited_passages():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(14)) for k in range(6)] + [(6, prose(12)[:33])]
    lemma = D.Lemma()
    index = D.PassageIndex(items, lemma)
    texts = []
    for k in range(40):
        _, passage = items[rng.randrange(7)]
        texts.append(prose(8) + " " + edited(rng, passage, rng.randrange(8)) + " " + prose(8))
    found = {(n, i): edits for n, i, _, _, edits, _ in index.search(texts)}
    for n, text in enumerate(texts):
        for i, passage in items:
            best = distance(" ".join(passage.split()), " ".join(text.split()))
            assert ((n, i) in found) == (best <= lemma.edits(len(passage))), (best, passage, text)
            if (n, i) in found:
                assert found[n, i] == best


def test_place_counts_code_points_of_the_text_as_given():
    passage = "The quick brown fox jumps over the lazy dog again"
    text = "🙂 é\n\n  THE  quick\nbrown fox jumps over the lazy dog again. End"
    (hit,) = D.PassageIndex([(1, passage)], D.Lemma()).search(["", text])
    assert hit[0] == 1 and text[hit[2] : hit[3]] == "THE  quick\nbrown fox jumps over the lazy dog again"


def test_hard_cases_and_clashing_columns(hard, table):
    passages = table([(1, None), (2, ""), (3, "short"), (4, "word5 word6 word7 word8 word9 word10 word11"), (4, "word5 word6 word7 word8 word9 word10 word11")], "item_id int, text string")
    rows = D.find_passages(hard, passages).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in rows) == [(6, 4, 0)] * 2 + [(7, 4, 0)] * 2


def test_blocks_of_passages_give_the_same(table):
    docs = table([(k, f"start of text {k} " + "passage number %d that is long enough to be found here" % (k % 3)) for k in range(9)])
    passages = table([(k, "passage number %d that is long enough to be found here" % k) for k in range(3)], "item_id int, text string")
    one = sorted(map(tuple, D.find_passages(docs, passages).collect()))
    assert one == sorted(map(tuple, D.find_passages(docs, passages, block_chars=60).collect()))
    assert {(r[0], r[1]) for r in one if r[4] == 0} == {(k, k % 3) for k in range(9)}


def test_empty_tables(nothing, hard, table):
    none = table([], "item_id int, text string")
    assert D.find_passages(nothing, table([(1, "a passage that is long enough to count")], "item_id int, text string")).count() == 0
    assert D.find_passages(hard, none).count() == 0


def test_hash_of_all_lengths_tells_grams_apart():
    for q in range(1, 14):
        hashes = D.gram_hashes(np.arange(100, dtype=np.uint32), q)
        assert len(hashes) == 101 - q == len(set(hashes.tolist()))


def test_blocks_are_read_one_by_one():
    from plumbline.llm.common import blocks_of

    read = []
    blocks = blocks_of((read.append(k) or k for k in range(10)), 3, lambda _: 1)
    assert next(blocks) == ([0, 1, 2], False) and read == [0, 1, 2, 3]
    assert list(blocks) == [([3, 4, 5], False), ([6, 7, 8], False), ([9], True)]
    assert list(blocks_of([], 3, len)) == []


def test_passages_of_every_length_against_brute_force():
    """Lengths 1 to 60: below the shortest of the lemma verbatim at word borders, else within the budget."""
    rng = random.Random(11)
    lemma = D.Lemma()
    source = " ".join("".join(rng.choice("abcdé4") for _ in range(rng.randint(1, 6))) for _ in range(60))
    items = []
    for m in range(1, 61):
        start = rng.randrange(len(source) - m)
        items.append((m, source[start : start + m]))
    texts = [source, source[: len(source) // 2], "x" + items[27][1] + "x", items[27][1], "before: " + items[4][1] + "!", "", "zz"]
    texts += [edited(rng, p, 1) for _, p in items[::3]]
    found = {(n, i): (a, b, e) for n, i, a, b, e, _ in D.PassageIndex(items, lemma).search(texts)}
    for n, text in enumerate(texts):
        for i, passage in items:
            plain = " ".join(passage.split())
            low = re.sub(r"\s+", " ", text)
            if not plain:
                want = False
            elif len(plain) < lemma.min_chars:
                at = [k for k in range(len(low) - len(plain) + 1) if low[k : k + len(plain)] == plain]

                def whole(k, plain=plain, low=low):
                    left = k and low[k - 1].isalnum() and plain[0].isalnum()
                    right = low[k + len(plain) : k + len(plain) + 1].isalnum() and plain[-1].isalnum()
                    return not left and not right

                want = any(map(whole, at))
            else:
                want = distance(plain, low) <= lemma.edits(len(plain))
            assert ((n, i) in found) == want, (passage, text)
            if want and len(plain) < lemma.min_chars:
                a, b, edits = found[n, i]
                assert edits == 0 and " ".join(text[a:b].split()) == plain


def test_short_passages_in_a_job(table):
    docs = table([(1, "Say  ABC d\nnow"), (2, "xabc d"), (3, "the answer is twenty-eight ok"), (4, None), (5, "\0abc d")])
    passages = table([(1, "abc D"), (2, "the answer is twenty-eight o"), (3, "the answer is twenty-eight"), (4, "abc D")], "item_id int, text string")
    rows = sorted((r.doc_id, r.item_id, r.start, r.end) for r in D.find_passages(docs, passages).collect())
    assert rows == [(1, 1, 5, 10), (1, 4, 5, 10), (3, 3, 0, 26), (5, 1, 1, 6), (5, 4, 1, 6)]


def test_repeats_are_aligned_in_parts(monkeypatch):
    passage = "ab" * 60
    text = "x " + "ba" * 3000 + " y"
    (whole,) = D.PassageIndex([(1, passage)], D.Lemma()).search([text])
    monkeypatch.setattr(D, "_BANDS", 3)
    (parts,) = D.PassageIndex([(1, passage)], D.Lemma()).search([text])
    assert whole == parts and whole[4] == 0 and text[whole[2] : whole[3]] == passage
