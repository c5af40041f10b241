"""Guess the text encoding of many files as one job."""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import col

# The byte-order marks, and the fallback.
BYTE_ORDER_MARKS = (
    (b"\xef\xbb\xbf", "utf-8-sig"),
    (b"\xff\xfe", "utf-16-le"),
    (b"\xfe\xff", "utf-16-be"),
)
PLAIN, FALLBACK = "utf-8", "latin-1"
BLOCK_BYTES = 1 << 20


def encoding_of(blocks: Iterable[bytes]) -> str:
    """The encoding of a file, given as blocks: its byte-order mark, UTF-8 if all of it is, else Latin-1."""
    decoder, first = codecs.getincrementaldecoder("utf-8")(), True
    try:
        for block in blocks:
            if first:
                for mark, name in BYTE_ORDER_MARKS:
                    if block.startswith(mark):
                        return name
                first = False
            decoder.decode(block)
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return FALLBACK
    return PLAIN


def detect_encodings(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, encoding, error) for a table of paths as the file systems of Arrow know them.

    Every file is read whole, in blocks. One that cannot be read has no encoding but an error.
    """

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_probe(p) for p in batch["path"]]
            yield pd.DataFrame({"path": batch["path"], "encoding": [f[0] for f in found], "error": [f[1] for f in found]})

    schema = "path string, encoding string, error string"
    return paths.select(col(path_col).cast("string").alias("path")).mapInPandas(probe, schema)


def file_encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, encoding) of every file that Spark finds under ``path``, by its own readers.

    Lines come as the bytes they are. A file is UTF-16 if its first line begins
    with that byte-order mark, UTF-8 if all its lines are, else Latin-1. Large files are
    read by many tasks; empty ones do not appear.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.is_valid_utf8("value").alias("plain"),
        F.when(F.col("_metadata.file_block_start") == 0, F.struct(F.monotonically_increasing_id(), F.substring(F.col("value").cast("binary"), 1, 2))).alias("head"),
    )
    marks = {mark: name for mark, name in BYTE_ORDER_MARKS if len(mark) == 2}
    first = F.hex(F.col("head.col2"))
    name = F.when(F.col("plain"), PLAIN)
    for mark, wide in marks.items():
        name = F.when(first == mark.hex().upper(), wide).otherwise(name)
    found = raw.groupBy("path").agg(F.bool_and("plain").alias("plain"), F.min("head").alias("head"))
    return found.select("path", F.coalesce(name, F.lit(FALLBACK)).alias("encoding"))


def _probe(path: str) -> tuple[str | None, str | None]:
    from pyarrow import fs

    try:
        system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_stream(place, compression=None) as stream:
            return encoding_of(iter(lambda: stream.read(BLOCK_BYTES), b"")), None
    except OSError as error:
        return None, str(error)
