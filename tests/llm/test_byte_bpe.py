import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from plumbline.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def test_byte_table_is_one_to_one():
    assert len(set(B.BYTE_CHARACTERS)) == 256
    assert B.as_bytes(B.as_characters(bytes(range(256)))) == bytes(range(256))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\t\x1c　'sldé🙂")), max_size=40), max_size=4))
def test_ids_equal_the_library(library, texts):
    codec = B.codec(PATH, PATTERN)
    ids = codec.encode(texts)
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode_bytes(i) for i in ids] == [t.encode() for t in texts]


def test_words_are_forgotten_and_learned_again(library):
    codec = B.ByteBpe(PATH, PATTERN, remembered=3)
    for k in range(6):
        texts = [f"word{k} other word{k} again, and{k}\n\n more", "the same words"]
        assert codec.encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_offsets_and_characters_cut_apart(table):
    row = B.encode(table([(1, "a 🙂é")]), PATH, PATTERN).first()
    codec = B.codec(PATH, PATTERN)
    assert row.ids == codec.encode(["a 🙂é"])[0]
    assert row.starts[0] == 0 and row.ends[-1] == 4
    assert all(a < b for a, b in zip(row.starts, row.ends))
    face = codec.encode(["🙂"])[0]
    assert len(face) > 1 and codec.decode(face[:1]) == "�" and codec.decode(face) == "🙂"


def test_hard_cases_round_trip(hard, library):
    rows = [(r.doc_id, r.text or "") for r in hard.collect()]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.round_trip(hard, PATH, PATTERN).collect()]
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_decode_gives_the_texts_back(hard):
    decoded = B.decode(B.encode(hard, PATH, PATTERN), PATH, PATTERN)
    assert sorted((repr(r.doc_id), r.text) for r in decoded.collect()) == sorted((repr(r.doc_id), r.text or "") for r in hard.collect())


def test_empty_table(nothing):
    assert B.round_trip(nothing, PATH, PATTERN).count() == 0
    assert B.encode(nothing, PATH, PATTERN).count() == 0
