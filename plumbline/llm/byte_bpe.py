"""Byte-level BPE with the tokenizers library over Arrow batches.

The vocabulary is a file of token bytes and ranks. The library works on
characters, so every byte is written as one printable character (the table of
:func:`byte_characters`) and the merges are derived from the ranks. Each match
of the split pattern is encoded on its own; special tokens are never looked
for. Decoding joins the tokens' characters, reverses the byte table and, for
text, puts a replacement character where the ids cut a character apart.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import id_and_text, one_thread, text_batches
from plumbline.session import ship_package


def byte_characters() -> str:
    """The 256 characters that stand for the bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


BYTE_CHARACTERS = byte_characters()
_TO_CHARACTER = dict(enumerate(BYTE_CHARACTERS))
_TO_BYTE = {ord(c): b for b, c in enumerate(BYTE_CHARACTERS)}


def as_characters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARACTER)


def as_bytes(characters: str) -> bytes:
    return characters.translate(_TO_BYTE).encode("latin-1")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """Every way to make a token out of two tokens, in order of the token's rank.

    A rank file allows any two neighbours to merge whose join is a token, so
    all splits of a token are listed, not only the one that made it.
    """
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda item: item[1]):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append((as_characters(token[:cut]), as_characters(token[cut:])))
    return merges


#: Unicode white space. A text can be cut before white space that follows anything else: no match
#: of a split pattern of this family reaches over such a place, so words can be encoded one by one.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


class ByteBpe:
    """Encoder and decoder of one rank file.

    ``remembered`` bounds the words whose ids are kept between batches (two
    generations of that many, so frequent ones survive).
    """

    def __init__(self, path: str, pattern: str, remembered: int = 150_000):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        one_thread()
        ranks = read_ranks(path)
        vocabulary = {as_characters(token): rank for token, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges_of(ranks), ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # The reversed byte table, applied to every token once.
        self.raw = {number: as_bytes(characters) for characters, number in vocabulary.items()}
        self.raw_of_decimal = {str(number): raw for number, raw in self.raw.items()}
        self.lengths = np.zeros(max(self.raw) + 1, np.int64)
        self.lengths[list(self.raw)] = [len(raw) for raw in self.raw.values()]
        self.remembered, self.young, self.old = remembered, {}, {}

    def _learn(self, words: set[str]) -> None:
        """Encode words and remember their ids as decimals joined by spaces."""
        joined = [w for w in words if w[0] in " \n" and not w.isspace()]
        alone = [w for w in words if w[0] not in " \n" or w.isspace()]
        runs = [joined[i : i + 2000] for i in range(0, len(joined), 2000)]
        encoded = self.tokenizer.encode_batch_fast(["".join(r) for r in runs] + alone, add_special_tokens=False)
        for run, one in zip(runs, encoded):
            ids = one.ids
            ends = np.cumsum([len(w.encode()) for w in run])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            decimals, start = list(map(str, ids)), 0
            for word, cut in zip(run, cuts.tolist()):
                self.young[word] = " ".join(decimals[start:cut])
                start = cut
        for word, one in zip(alone, encoded[len(runs) :]):
            self.young[word] = " ".join(map(str, one.ids))

    def encode_decimals(self, texts: Sequence[str]) -> list[str]:
        """Each text's ids as decimals joined by spaces."""
        words = [_WORD.findall(text) for text in texts]
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = set()
        for one in words:
            for word in one:
                if word not in young:
                    if word in old:
                        young[word] = old[word]
                    else:
                        new.add(word)
        if new:
            self._learn(new)
        return [" ".join(map(young.__getitem__, one)) for one in words]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [list(map(int, line.split())) for line in self.encode_decimals(texts)]

    def encode_with_offsets(self, texts: Sequence[str]) -> list[tuple[list[int], list[int], list[int]]]:
        """Ids with the first and the end character of the text that each touches.

        A character that several tokens share (its bytes are cut apart) lies in
        the range of each of them.
        """
        return [
            (e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets])
            for e in self.tokenizer.encode_batch(list(texts), add_special_tokens=False)
        ]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """The text; bytes that make no whole character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec per worker process and vocabulary."""
    return ByteBpe(path, pattern)


def _id_field(df: DataFrame) -> T.StructField:
    return T.StructField("doc_id", df.schema["doc_id"].dataType)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends (the code points each id covers); one row for every row of ``docs``.

    Null and empty texts have empty lists; a null id is kept. ``path`` must be
    readable on every executor.
    """
    source = id_and_text(docs, id_col, text_col)
    numbers = T.ArrayType(T.IntegerType())

    def run(batches):
        bpe = codec(path, pattern)
        for batch in text_batches(batches, chars=1_000_000):
            found = bpe.encode_with_offsets(batch.column("text").to_pylist())
            columns = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "ids", "starts", "ends"])

    return source.mapInArrow(
        run, T.StructType([_id_field(source), *(T.StructField(n, numbers) for n in ("ids", "starts", "ends"))])
    )


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of lists of ids. A null list gives a null text, an unknown id fails."""
    ship_package(encoded.sparkSession)
    source = encoded.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids")

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return source.mapInArrow(run, T.StructType([_id_field(source), T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: its ids and what they decode to, as digests.

    Encodes and decodes in one pass, so that no list of ids leaves its task.
    """
    source = id_and_text(docs, id_col, text_col)

    def run(batches):
        bpe = codec(path, pattern)
        for batch in text_batches(batches, chars=1_000_000):
            counts, ids_sha, text_sha = [], [], []
            for decimals in bpe.encode_decimals(batch.column("text").to_pylist()):
                ids = decimals.split()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(decimals.encode()).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(map(bpe.raw_of_decimal.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return source.mapInArrow(
        run,
        T.StructType(
            [
                _id_field(source),
                T.StructField("n_tokens", T.LongType()),
                T.StructField("ids_sha256", T.StringType()),
                T.StructField("decoded_sha256", T.StringType()),
            ]
        ),
    )
