"""Read files and database tables into DataFrames."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import LoadError, PlumblineError, SourceNotFound, UnsupportedFormat
from plumbline.functions.columns import col
from plumbline.functions.parsing import NULL_TOKENS, blank_to_null
from plumbline.operators.casts import apply_casts, infer_casts
from plumbline.session import small_table
from plumbline.sources import spec as S
from plumbline.sources.encoding import file_encodings

CORRUPT = "_corrupt_record"
AUTO = "auto"

# The names that Spark's readers have for the encodings found.
SPARK_NAMES = {"utf-8": "UTF-8", "utf-16-le": "UTF-16", "utf-16-be": "UTF-16", "latin-1": "ISO-8859-1"}

# The tiers a load can end in.
FULL, DEGRADED = "none", "degraded"


def supported_extensions() -> list[str]:
    return list(S.EXTENSIONS)


def read_file(
    spark: SparkSession,
    path: str,
    row_cap: int | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
    encoding: str = "UTF-8",
    infer_types: bool = True,
    keep_corrupt: bool = False,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read one file or folder; the reader follows the extension.

    Rows are those of the file; bad CSV rows are cut or filled with nulls.
    ``encoding`` holds for delimited text; "auto" finds that of every file.
    ``row_cap`` takes any so many rows. ``keep_corrupt`` adds the raw text of
    bad rows as ``_corrupt_record``.
    """
    ending = S.extension(path)
    if ending not in S.EXTENSIONS:
        raise UnsupportedFormat(ending or "<no extension>")
    kind = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet"}.get(ending, "json")
    return _read(spark, path, kind, row_cap, null_tokens, encoding, infer_types, keep_corrupt, options or {})


def _read(spark, path, kind, row_cap, null_tokens, encoding, infer_types, keep_corrupt, options) -> DataFrame:
    try:
        if kind == "parquet":
            df = spark.read.options(**options).parquet(path)
        elif kind == "json":
            df = read_json(spark, path, keep_corrupt, options)
        else:
            separator = "\t" if kind == "tsv" else ","
            df = read_delimited(
                spark, path, separator, null_tokens, encoding, infer_types, keep_corrupt, options
            )
    except (PySparkException, Py4JJavaError) as error:
        if isinstance(error, PySparkException) and error.getCondition() == "PATH_NOT_FOUND":
            raise SourceNotFound(path) from error
        raise LoadError(f"cannot read '{path}': {error}") from error
    return df if row_cap is None else df.limit(row_cap)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    separator: str = ",",
    null_tokens: Sequence[str] = NULL_TOKENS,
    encoding: str = "UTF-8",
    infer_types: bool = True,
    keep_corrupt: bool = False,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read delimited text with a header line.

    Values arrive as text, null tokens become null, and then each column gets
    the narrowest type that all its values fit, which costs one pass. All files
    of a folder need the same header; another one is an error, found in that
    pass (or in the first query without ``infer_types``). Values with line
    breaks are recognised by lines with an odd number of quotes; such sources
    are read whole file by file, others split. Say ``multiLine`` in ``options``
    to save that look. The ``encoding`` "auto" is found for every file
    (``file_encodings``), in one more pass; files of one encoding are read
    together.
    """
    options = dict(options or {})
    if encoding.lower() == AUTO:
        df = _read_by_encoding(spark, path, separator, null_tokens, keep_corrupt, options)
        return apply_casts(df, infer_casts(df.drop(CORRUPT))) if infer_types else df
    if not any(name.lower() == "multiline" for name in options):
        options["multiLine"] = _has_open_quotes(spark, path, encoding)
    reader = spark.read.options(
        header=True, sep=separator, mode="PERMISSIVE", encoding=encoding, escape='"', enforceSchema=False, **options
    )
    names = reader.csv(path).columns
    if not names:
        raise LoadError(f"file is empty: {path}")
    fields = [T.StructField(n, T.StringType()) for n in names]
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    raw = reader.schema(T.StructType(fields)).csv(path)
    extra = [col(CORRUPT)] if keep_corrupt else []
    df = raw.select(*[blank_to_null(col(n), null_tokens).alias(n) for n in names], *extra)
    if infer_types:
        df = apply_casts(df, infer_casts(df.drop(CORRUPT)))
    return df


def _read_by_encoding(spark, path, separator, null_tokens, keep_corrupt, options) -> DataFrame:
    """All values as text, of files whose encodings may differ; the headers may not."""
    groups: dict[str, list[str]] = {}
    for row in file_encodings(spark, path).toLocalIterator():  # the driver lists the files of a read anyway
        groups.setdefault(row["encoding"], []).append(_literal_path(row["path"]))
    if not groups:
        raise LoadError(f"file is empty: {path}")
    parts = []
    for name, files in sorted(groups.items()):
        parts.append(read_delimited(spark, sorted(files), separator, null_tokens, SPARK_NAMES[name], False, keep_corrupt, options))
    if len({frozenset(p.columns) for p in parts}) > 1:
        raise LoadError(f"files of {path} have different headers: {sorted({','.join(p.columns) for p in parts})}")
    return reduce(DataFrame.unionByName, parts)


def _literal_path(uri: str) -> str:
    """A path as Spark names it, in the form that its readers take: without escapes, and no character a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(uri))


def _has_open_quotes(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a line holds an odd number of quotes, so that a value goes on in the next line."""
    if encoding.upper().replace("-", "") not in ("UTF8", "USASCII", "ISO88591", "LATIN1"):
        return True
    value = F.col("value")
    odd = (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1
    return not spark.read.text(path).where(odd).isEmpty()


def read_json(
    spark: SparkSession, path: str, keep_corrupt: bool = False, options: Mapping[str, str] | None = None
) -> DataFrame:
    """Read JSON lines, an array of objects, or one object.

    Text that is no JSON is an error, unless ``keep_corrupt`` asks for it as
    ``_corrupt_record``. Lines are tried first (an array on one line is a
    line, too) and can be split; an array or object over several lines is one
    task per file, and its file must hold nothing else.
    """
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first()
    if first is None:
        raise LoadError(f"file is empty: {path}")
    if first[0] not in "[{":
        raise LoadError(f"JSON root must be an array or an object: {path}")
    # Finding the schema parses everything, and names the corrupt column only if something is no JSON.
    reader = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **(options or {}))
    lines = reader.json(path)
    if lines.columns and CORRUPT not in lines.columns:
        return lines
    has_records = lines.columns not in ([], [CORRUPT])
    if first[0] == "[" or not has_records:  # else some lines are objects and others are broken
        whole = reader.json(path, multiLine=True)
        if whole.columns and CORRUPT not in whole.columns:
            return whole
    if keep_corrupt and has_records:
        return lines
    raise LoadError(f"JSON cannot be parsed: {path}")


def read_postgres(spark: SparkSession, uri: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Read a Postgres table over JDBC.

    Give ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` as options to read a large table with many tasks.
    """
    table = S.parse_postgres(uri)
    reader = spark.read.format("jdbc").option("url", table.url).option("dbtable", table.dbtable)
    try:
        return reader.options(**table.properties, **(options or {})).load()
    except Exception as error:
        raise LoadError(f"cannot read Postgres table {table.dbtable}: {error}") from error


def read_source(spark: SparkSession, source: S.SourceSpec, keep_corrupt: bool = False) -> DataFrame:
    """Read a described source. Object stores need the matching Hadoop connector."""
    path = S.hadoop_path(source.uri)
    if source.kind == S.POSTGRES:
        df = read_postgres(spark, source.uri, source.options)
        return df if source.row_cap is None else df.limit(source.row_cap)
    ending = S.extension(source.uri)
    if ending not in S.EXTENSIONS:
        if source.kind in (S.CSV, S.PARQUET):
            return _read(
                spark, path, source.kind, source.row_cap, NULL_TOKENS, "UTF-8", True, keep_corrupt,
                source.options,
            )
        raise UnsupportedFormat(ending or "<no extension>")
    return read_file(spark, path, source.row_cap, keep_corrupt=keep_corrupt, options=source.options)


@dataclass(frozen=True)
class Loaded:
    """Frames by source id, in the order of the sources, and how each load went."""

    frames: dict[str, DataFrame]
    status: DataFrame


def load_with_status(spark: SparkSession, sources: Sequence[S.SourceSpec], read_all: bool = False) -> Loaded:
    """Load every source on its own, so that a bad one does not lose the others.

    A source that cannot be read whole has no frame; its tier is "degraded" and
    its warning says why. The status has one row per source: source_id, uri,
    tier, row_count, corrupt_rows, warning (also for cut or filled rows of a
    delimited text). Parquet rows are counted from file footers; ``read_all``
    reads every value, so that damaged data shows here and not later.
    """
    frames, status = {}, []
    for source in sources:
        tier, warning, counts = FULL, None, (0, 0)
        try:
            frame = read_source(spark, source, keep_corrupt=source.kind != S.JSON)
            counts = _count(frame, read_all)
            if counts[1]:
                warning = f"{counts[1]} rows do not fit the header"
            frames[source.source_id] = frame.drop(CORRUPT)
        except (PlumblineError, PySparkException, Py4JJavaError) as error:
            tier, warning = DEGRADED, str(error)
        status.append((source.source_id, source.uri, tier, *counts, warning))
    table = small_table(
        spark,
        status,
        "source_id string, uri string, tier string, row_count bigint, corrupt_rows bigint, warning string",
    )
    return Loaded(frames, table)


def _count(frame: DataFrame, read_all: bool) -> tuple[int, int]:
    """Rows and corrupt rows. Text formats are parsed in full to know which rows are corrupt."""
    has_corrupt = CORRUPT in frame.columns
    corrupt = F.count(col(CORRUPT)) if has_corrupt else F.lit(0)
    touched = [F.count(col(c)) for c in frame.columns if c != CORRUPT] if read_all or has_corrupt else []
    row = frame.agg(F.count("*"), corrupt, *touched).first()
    return row[0], row[1]
