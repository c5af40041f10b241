"""What the text operators share: input columns, vocabulary arrays, bounded broadcasts."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize, release, ship_package


def place_of(df: DataFrame, name: str) -> int:
    """Where a column stands: the one of this very name, else the only one of this name in any letter case."""
    same = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(same) != 1:
        raise ValueError(f"{len(same)} columns are called {name}")
    return same[0]


def positioned(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, ..., so that none of its names can clash with an inner one."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def picked(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns named, each under its keyword."""
    places = {new: place_of(df, name) for new, name in names.items()}
    return positioned(df).select(*[F.col(f"c{k}").alias(new) for new, k in places.items()])


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``; a null text is empty.

    Whatever else the table holds, under whatever name, is left behind here, so
    no operator can clash with it.
    """
    ship_package(df.sparkSession)
    return picked(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))


def text_mark(text: Column) -> Column:
    """What tells a text from others, null and empty being one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def plain_text(column: Column) -> Column:
    """Every run of ASCII white space as one space (runs that are one space already are not touched)."""
    return F.regexp_replace(column, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


class Copies:
    """Writes frames into the shared folder and deletes them when their results stand on their own."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(materialize(df))
        return self.frames[-1]

    def release(self) -> None:
        for frame in self.frames:
            release(frame)
        self.frames = []


#: Bits of the broadcast filter of a set of keys. It is fixed: 64 bits to a row, so a million rows at most,
#: however many keys there are; more keys let more rows pass to the exact join behind it.
FILTER_BITS = 1 << 26


def _with_bit(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    slot = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    words = (
        keys.select(F.floor(slot / 64).alias("__word"), F.expr(f"shiftleft(1L, int(pmod(key, {FILTER_BITS}L) % 64))").alias("bit"))
        .groupBy("__word")
        .agg(F.bit_or("bit").alias("__bits"))
    )
    own = F.pmod(key, F.lit(FILTER_BITS))
    return (
        df.withColumn("__slot", own)
        .withColumn("__word", F.floor(F.col("__slot") / 64))
        .join(F.broadcast(words), "__word", "left")
        .withColumn("__in", F.coalesce(F.getbit("__bits", (F.col("__slot") % 64).cast("int")) == 1, F.lit(False)))
        .drop("__slot", "__word", "__bits")
    )


def maybe_in(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose 64-bit ``key`` may be among ``keys`` (column ``key``): all that are, and a few that are not."""
    return _with_bit(df, key, keys).where("__in").drop("__in")


def surely_not_in(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The other rows of :func:`maybe_in`."""
    return _with_bit(df, key, keys).where(~F.col("__in")).drop("__in")


def without_ids(rows: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (an inner table) without the ids in ``gone`` (column ``doc_id``), moving nothing of the rows that surely stay."""
    key, keys = F.xxhash64(F.col(id_col)), gone.select(F.xxhash64("doc_id").alias("key"))
    left = maybe_in(rows, key, keys).alias("l")
    same = F.col(f"l.{id_col}").eqNullSafe(F.col("r.doc_id"))
    return surely_not_in(rows, key, keys).unionByName(left.join(gone.alias("r"), same, "left_anti"))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark=text_mark) -> DataFrame:
    """``docs`` without the rows whose id (null or not) and text are in ``gone`` (columns ``doc_id`` and ``mark``).

    Other rows that share only the id, or only the text, stay, and so do all
    columns under their names, whatever these are. Only rows whose id may be in
    ``gone`` are compared; the others' texts are not moved.
    """
    rows, own, text = positioned(docs), f"c{place_of(docs, id_col)}", f"c{place_of(docs, text_col)}"
    key, keys = F.xxhash64(own), gone.select(F.xxhash64("doc_id").alias("key"))
    left = maybe_in(rows, key, keys).withColumn("__mark", mark(F.col(text))).alias("l")
    same = F.col(f"l.{own}").eqNullSafe(F.col("r.doc_id")) & (F.col("l.__mark") == F.col("r.mark"))
    kept = left.join(gone.alias("r"), same, "left_anti").drop("__mark")
    return surely_not_in(rows, key, keys).unionByName(kept).toDF(*docs.columns)


#: A group is hot if it has more than one row in so many; no more groups than that can be, however large the table.
HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows with a row of their group. Hot groups, by their ``size`` and the ``total`` of rows, are broadcast.

    The others meet their rows in a shuffle, in which no key has a large share.
    """
    hot_rows = max(2, total // HOT_GROUPS)
    hot = groups.where(F.col(size) > hot_rows).withColumn("__hot", F.lit(True))
    first = rows.join(F.broadcast(hot), key, "left")
    rest = first.where("__hot IS NULL").select(*rows.columns).join(groups.where(F.col(size) <= hot_rows), key, how)
    return first.where("__hot").drop("__hot").unionByName(rest)


def blocks_of(items, limit: int, size):
    """Consecutive blocks of ``items`` whose summed ``size`` stays below ``limit`` (single larger items stand alone), and whether each is the last.

    No more than a block and one item of ``items`` is held.
    """
    current, held = [], 0
    for item in items:
        n = size(item)
        if current and held + n > limit:
            yield current, False
            current, held = [], 0
        current.append(item)
        held += n
    if current:
        yield current, True


def text_batches(batches, rows: int = 512, chars: int = 4_000_000):
    """Slices of Arrow batches (columns doc_id, text) of bounded rows and bytes, whatever the session's batch size."""
    for batch in batches:
        start, n = 0, batch.num_rows
        if not n:
            continue
        texts = batch.column("text")
        lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        ends = np.cumsum(lengths)
        while start < n:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + chars, side="right"))
            stop = min(max(stop, start + 1), start + rows, n)
            yield batch.slice(start, stop - start)
            start = stop


def one_thread() -> None:
    """Keep native libraries in a task to the core that Spark gave it."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
