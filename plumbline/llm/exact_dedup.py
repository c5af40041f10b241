"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each sender (a bounded frame of rows of one partition) sends every owner the
sorted, distinct fingerprints of the owner's range, Rice-coded (Golomb codes
with a power of two). An owner answers each sender with a bitmap of the
fingerprints that also occur elsewhere. Only rows behind a set bit are
suspects; only their texts are shuffled, and compared byte by byte.

Fingerprints have log2(rows) + ``spare_bits`` bits, so that one costs about
``spare_bits`` + 2 bits on the wire and one row in 2**spare_bits is a false
suspect, which the comparison clears.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import id_and_text, maybe_in, place_of, plain_text, positioned, surely_not_in, without_rows
from plumbline.session import materialize

#: Most rows that a hot group may have before its members are matched by a
#: broadcast instead of a shuffle; it is a share of all rows, so that at most
#: HOT_GROUPS groups can be hot, however large the table.
HOT_GROUPS = 1000


# --- Rice codes ---------------------------------------------------------------------------------


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted values as Rice-coded gaps: the unary quotients, then the k-bit remainders."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    remainders = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    head = np.array([len(gaps), k, len(unary)], np.int64)
    return head.tobytes() + np.packbits(unary).tobytes() + np.packbits(remainders.ravel()).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    """The sorted values of :func:`rice_encode`."""
    n, k, length = np.frombuffer(blob, np.int64, 3)
    body = np.frombuffer(blob, np.uint8, offset=24)
    cut = -(-int(length) // 8)
    stops = np.flatnonzero(np.unpackbits(body[:cut], count=int(length)) == 0)
    quotients = (np.diff(stops, prepend=-1) - 1).astype(np.uint64)
    remainders = np.zeros(int(n), np.uint64)
    if k:
        bits = np.unpackbits(body[cut:], count=int(n * k)).reshape(int(n), int(k))
        for column in range(int(k)):
            remainders = (remainders << np.uint64(1)) | bits[:, column]
    return np.cumsum((quotients << np.uint64(k)) | remainders, dtype=np.uint64)


# --- exchange -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Exchange:
    """Sizes of one exchange: ``bits`` of a fingerprint, of which the first ``owner_bits`` name the owner."""

    bits: int
    owner_bits: int
    frame_rows: int = 200_000

    @classmethod
    def for_rows(cls, rows: int, spare_bits: int = 12, owner_rows: int = 500_000, frame_rows: int = 200_000):
        owners = max(5, math.ceil(math.log2(max(rows / owner_rows, 1))))
        return cls(min(63, max(owners + 1, math.ceil(math.log2(max(rows, 2))) + spare_bits)), owners, frame_rows)


def _send(exchange: Exchange, id_type: pa.DataType):
    schema = pa.schema(
        [
            ("doc_id", id_type),
            ("sha", pa.binary()),
            ("cell", pa.int64()),
            ("place", pa.int32()),
            ("sender", pa.int64()),
            ("owner", pa.int32()),
            ("codes", pa.binary()),
            ("repeated", pa.binary()),
        ]
    )
    low_bits = exchange.bits - exchange.owner_bits

    def frame(number: int, ids: list, shas: list):
        sha = pa.concat_arrays(shas)
        head = np.frombuffer(b"".join(x[:8] for x in sha.to_pylist()), ">u8").astype(np.uint64)
        values, inverse, counts = np.unique(head >> np.uint64(64 - exchange.bits), return_inverse=True, return_counts=True)
        owners = (values >> np.uint64(low_bits)).astype(np.int32)
        starts = np.searchsorted(owners, np.arange(1 << exchange.owner_bits))
        ends = np.append(starts[1:], len(values))
        sender = (TaskContext.get().partitionId() << 20) | number
        own = owners[inverse]
        rows = pa.table(
            {
                "doc_id": pa.concat_arrays(ids),
                "sha": sha,
                "cell": (np.int64(sender) << np.int64(exchange.owner_bits)) | own.astype(np.int64),
                "place": (inverse - starts[own]).astype(np.int32),
            }
        )
        sent = [(int(o), starts[o], ends[o]) for o in np.flatnonzero(ends > starts)]
        codes, repeated = [], []
        for _, a, b in sent:
            low = values[a:b] & np.uint64((1 << low_bits) - 1)
            k = max(0, int(math.log2(max((1 << low_bits) * math.log(2) / (b - a), 1))))
            codes.append(rice_encode(low, k))
            repeated.append(np.packbits(counts[a:b] > 1).tobytes())
        wire = pa.table(
            {
                "sender": pa.array([sender] * len(sent), pa.int64()),
                "owner": pa.array([o for o, _, _ in sent], pa.int32()),
                "codes": pa.array(codes, pa.binary()),
                "repeated": pa.array(repeated, pa.binary()),
            }
        )
        for table in (rows, wire):
            filled = pa.table([table[f.name].cast(f.type) if f.name in table.column_names else pa.nulls(len(table), f.type) for f in schema], schema)
            yield from filled.to_batches(max_chunksize=20_000)

    def send(batches):
        ids, shas, held, number = [], [], 0, 0
        for batch in batches:
            ids.append(batch.column("doc_id"))
            shas.append(batch.column("sha"))
            held += batch.num_rows
            if held >= exchange.frame_rows:
                yield from frame(number, ids, shas)
                ids, shas, held, number = [], [], 0, number + 1
        if held:
            yield from frame(number, ids, shas)

    return send


def _answer(table: pa.Table) -> pa.Table:
    """The owner's part: which fingerprints of each sender occur more than once among all senders."""
    lists = [rice_decode(x) for x in table["codes"].to_pylist()]
    lengths = [len(x) for x in lists]
    own = [np.unpackbits(np.frombuffer(r, np.uint8), count=n).astype(bool) for r, n in zip(table["repeated"].to_pylist(), lengths)]
    values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    again = counts > 1
    np.logical_or.at(again, inverse, np.concatenate(own))
    flags, at, bitmaps = again[inverse], 0, []
    for n in lengths:
        bits = np.zeros(-(-n // 64) * 64, np.uint8)
        bits[:n] = flags[at : at + n]
        bitmaps.append(np.packbits(bits, bitorder="little").view(np.int64).tolist() if bits.any() else [])
        at += n
    return pa.table({"sender": table["sender"], "owner": table["owner"], "bitmap": pa.array(bitmaps, pa.list_(pa.int64()))})


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    spare_bits: int = 12,
    owner_rows: int = 500_000,
    frame_rows: int = 200_000,
) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256; one row for every row of ``docs``.

    Texts are equal when they are the same bytes after each run of ASCII white
    space has become one space; null counts as the empty text, so all null and
    empty texts are one group. The row with the smallest id of a group stays
    (``kept``). Rows that share the group's smallest id all stay, as nothing
    tells them apart; a null id is never the smallest unless the whole group
    has none. An empty table gives an empty result.
    """
    source = id_and_text(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType
    rows = docs.count()
    exchange = Exchange.for_rows(rows, spare_bits, owner_rows, frame_rows)
    plain = source.select("doc_id", plain_text(F.col("text")).alias("plain"))
    hashed = plain.withColumn("sha", _digest(F.col("plain")))

    # Senders: one scan gives every row its place in its sender's lists, and the lists for the owners.
    sent_type = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("sha", T.BinaryType()),
            T.StructField("cell", T.LongType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("sender", T.LongType()),
            T.StructField("owner", T.IntegerType()),
            T.StructField("codes", T.BinaryType()),
            T.StructField("repeated", T.BinaryType()),
        ]
    )
    arrow_id = pa.schema([("x", _arrow_type(id_type))]).field("x").type
    sent = materialize(hashed.select("doc_id", "sha").mapInArrow(_send(exchange, arrow_id), sent_type))

    # Owners: bitmaps go back to the senders, keyed by sender and owner.
    bitmaps = (
        sent.where(F.col("codes").isNotNull())
        .select("sender", "owner", "codes", "repeated")
        .groupBy("owner")
        .applyInArrow(_answer, "sender long, owner int, bitmap array<long>")
        .where(F.size("bitmap") > 0)
        .select((F.shiftleft("sender", exchange.owner_bits).bitwiseOR(F.col("owner").cast("long"))).alias("cell"), "bitmap")
    )
    listed = sent.where(F.col("sha").isNotNull()).select("doc_id", "sha", "cell", "place")
    word = F.get("bitmap", F.floor(F.col("place") / 64).cast("int"))
    marked = materialize(
        listed.join(bitmaps, "cell", "left").select(
            "doc_id", "sha", F.coalesce(F.getbit(word, F.col("place") % 64) == 1, F.lit(False)).alias("suspect")
        )
    )
    suspects = marked.where("suspect").select("doc_id", "sha")

    # Suspects' texts: a filter of fixed size picks them in the scan, equal texts are counted
    # inside each task first, and grouping by the text itself is the comparison of the bytes.
    texts = maybe_in(hashed, F.xxhash64("sha"), suspects.select(F.xxhash64("sha").alias("key"))).select("doc_id", "sha", "plain")
    counted = materialize(
        texts.groupBy("sha", "plain")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .withColumn("text_key", F.xxhash64("plain"))
        .drop("plain")
    )
    groups = counted.where("group_size > 1")
    # Digests that different texts have, be they repeated or not; there is none unless SHA-256 is broken.
    shared = counted.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha")
    clash = not shared.isEmpty()

    # Members: hot groups are few by definition and are broadcast; the others meet their members in a shuffle.
    hot_rows = max(rows // HOT_GROUPS, 2)
    single = groups.drop("text_key")
    if clash:
        single = single.join(shared, "sha", "left_anti")
    hot = single.where(F.col("group_size") > hot_rows).withColumn("hot", F.lit(True))
    cold = single.where(F.col("group_size") <= hot_rows)
    by_hot = suspects.join(F.broadcast(hot), "sha", "left")
    members = by_hot.where("hot").drop("hot").unionByName(
        by_hot.where("hot is null").select("doc_id", "sha").join(cold, "sha", "left")
    )
    if clash:  # their members are found by the text
        members = members.join(shared, "sha", "left_anti").unionByName(
            texts.withColumn("text_key", F.xxhash64("plain")).drop("plain")
            .join(shared, "sha", "left_semi")
            .join(groups, ["sha", "text_key"], "left")
            .select("doc_id", "sha", "keep_id", "group_size")
        )
    alone = marked.where(~F.col("suspect")).select("doc_id", "sha", F.lit(None).cast(id_type).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return members.unionByName(alone).select(
        "doc_id",
        keep.alias("keep_id"),
        size.alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text an earlier id has; all columns stay.

    Null and empty texts are equal. A row without an id goes where a row with
    one has its text. Rows that repeat id and text (or have no id and one text)
    come once; rows with one id and different texts are judged each. An empty
    table gives an empty result.
    """
    decided = materialize(exact_groups(docs, id_col, text_col, **options).select("doc_id", "text_sha256", "kept"))

    def mark(text):
        return F.lower(F.hex(_digest(plain_text(F.coalesce(text, F.lit(""))))))

    left = without_rows(docs, decided.where(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("mark")), id_col, text_col, mark)
    repeated = decided.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select(F.xxhash64("doc_id").alias("key"))
    rows, own, text = positioned(left), f"c{place_of(left, id_col)}", f"c{place_of(left, text_col)}"
    key = F.xxhash64(own)
    once = maybe_in(rows, key, repeated).withColumn("__mark", mark(F.col(text))).dropDuplicates([own, "__mark"]).drop("__mark")
    return surely_not_in(rows, key, repeated).unionByName(once).toDF(*docs.columns)


def _digest(plain):
    return F.unhex(F.sha2(plain.cast("binary"), 256))
