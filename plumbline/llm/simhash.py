"""Near copies by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits, one for each majority among the XXH64 hashes of a
text's word shingles. Every bit place gets a code of ``radius`` + 1 binary
digits, and each of the 2 ** (radius + 1) - 1 digit choices v other than zero
is a table: it looks at the places whose code has an odd number of digits in
common with v. Two fingerprints that differ in at most ``radius`` places always
agree in some table, because so few codes leave a v that meets none of them
(radius equations in radius + 1 unknowns). Nothing is left to chance.

Inside a bucket nothing is compared in pairs. Two fingerprints are within an
even radius exactly if they are both within half of it of some centre, and they
may differ only in the places their tables do not look at. So every fingerprint
with company names the centres within half the radius over those places, and
fingerprints that name the same centre are linked. There are at most 65 centres
to a fingerprint and 65 fingerprints to a centre (radius 2), however large a
family of near copies is.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chosen_path import components
from plumbline.llm.common import Copies, id_and_text, join_groups, text_batches
from plumbline.session import materialize

BITS = 64
#: Shingles whose bits are counted at once.
_PIECE = 1 << 16


def _hashes(text: str, words: int, seed: int):
    """XXH64 of every shingle of a text, in arrays of bounded length; nothing for a text without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - span + 1], ends[span - 1 :]
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(starts), _PIECE):
        pairs = zip(starts[a : a + _PIECE].tolist(), ends[a : a + _PIECE].tolist())
        yield np.array([digest(joined[x:y], seed) for x, y in pairs], np.uint64)


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The bits that more than half of the text's shingle hashes have; 0 for a text without words.

    Bytes are lower-cased and cut where ASCII is concerned only: ``bytes.lower``
    and ``bytes.split`` touch A-Z and 0x20, 0x09-0x0D and leave other UTF-8 be.
    """
    total, count = np.zeros(BITS, np.int64), 0
    for hashed in _hashes(text, words, seed):
        count += len(hashed)
        total += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int, seed: int):
    def run(batches):
        for batch in text_batches(batches):
            found = [fingerprint(t, words, seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fingerprint"]
            )

    return run


def masks(radius: int = 2, bits: int = BITS) -> list[int]:
    """The places each table looks at, as signed 64-bit masks. Codes are dealt in turn, so tables look at equally many."""
    digits = radius + 1
    codes = [1 + place % ((1 << digits) - 1) for place in range(bits)]
    chosen = range(1, 1 << digits)
    return [_signed(sum(1 << place for place, code in enumerate(codes) if (code & v).bit_count() % 2)) for v in chosen]


def flips(radius: int = 2, bits: int = BITS) -> list[int]:
    """Every choice of at most half the radius of places."""
    return [_signed(sum(1 << p for p in places)) for n in range(radius // 2 + 1) for places in combinations(range(bits), n)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """node, root: edges that connect exactly the fingerprints that links connect.

    ``prints`` has different 64-bit numbers in ``fingerprint``. Rows grow in
    proportion to them: the tables first, then the centres of those with company.
    """
    if radius not in (0, 2, 4):
        raise ValueError("fingerprints meet half-way, so the radius must be 0, 2 or 4")
    tables = F.array(*(F.struct(F.lit(n).alias("table"), F.lit(m).alias("mask")) for n, m in enumerate(masks(radius))))
    dealt = prints.select("fingerprint", F.explode(tables).alias("t")).select(
        "fingerprint", "t.table", "t.mask", F.col("fingerprint").bitwiseAND(F.col("t.mask")).alias("bucket")
    )
    company = dealt.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("table", "bucket")
    free = dealt.join(company, ["table", "bucket"], "left_semi").groupBy("fingerprint").agg(F.bit_or(F.bitwise_not("mask")).alias("free"))
    ways = F.filter(F.array(*map(F.lit, flips(radius))), lambda f: f.bitwiseAND(F.bitwise_not(F.col("free"))) == 0)
    named = free.select("fingerprint", F.explode(F.transform(ways, lambda f: f.bitwiseXOR(F.col("fingerprint")))).alias("centre"))
    # No more fingerprints than flips name a centre, so these lists are bounded.
    met = named.groupBy("centre").agg(F.array_sort(F.collect_list("fingerprint")).alias("members")).where(F.size("members") > 1)
    return met.select(F.explode(F.slice("members", 2, len(flips(radius)))).alias("node"), F.get("members", F.lit(0)).alias("root")).distinct()


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, radius: int = 2, seed: int = 42
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs``.

    Words are cut at ASCII white space and A-Z lower-cased; shingles of
    ``words`` words count as often as they occur; a shorter text is one shingle.
    A null, empty or blank text has the fingerprint zero, which links like any
    other. ``component_id`` is the smallest id that links of at most ``radius``
    different bits reach, null only where no row reached has an id. Rows with
    one id, and repeated rows, are rows of their own. An empty table gives an
    empty result.
    """
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = materialize(source.mapInArrow(_fingerprints(words, seed), f"doc_id {kind}, fingerprint long"))
    copy = Copies()  # deleted once the components are written
    prints = copy(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows")))
    roots = components(copy(links(prints.select("fingerprint"), radius)), copy)
    placed = prints.join(roots, prints.fingerprint == roots.node, "left").select(
        "fingerprint", "n_rows", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = materialize(placed.join(named, "root").select("fingerprint", "n_rows", "component_id"))
    copy.release()
    members = join_groups(rows, groups, "fingerprint", "n_rows", rows.count())
    return members.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
