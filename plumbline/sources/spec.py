"""Describe where a table comes from."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from urllib.parse import unquote, urlsplit

from plumbline.errors import LoadError

CSV, PARQUET, JSON, POSTGRES, DUCKDB, UNKNOWN = "csv", "parquet", "json", "postgres", "duckdb", "unknown"

# Endings and schemes that tell the kind of a source, and the readable file extensions.
KIND_BY_ENDING = {".csv": CSV, ".parquet": PARQUET, ".json": JSON, ".jsonl": JSON, ".duckdb": DUCKDB}
POSTGRES_SCHEMES = ("postgresql://", "postgres://")
EXTENSIONS = (".csv", ".tsv", ".parquet", ".json", ".jsonl", ".ndjson")
DEFAULT_SCHEMA = "public"
TABLE_MARK = "::"


@dataclass(frozen=True)
class SourceSpec:
    """A source to load. The kind is guessed from the URI unless it is given."""

    uri: str
    kind: str = UNKNOWN
    name: str | None = None
    row_cap: int | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    source_id: str = field(default_factory=lambda: uuid.uuid4().hex[:8])

    def __post_init__(self) -> None:
        uri = self.uri.strip()
        if not uri:
            raise ValueError("a source needs a URI")
        object.__setattr__(self, "uri", uri)
        if self.kind == UNKNOWN:
            object.__setattr__(self, "kind", guess_kind(uri))

    @property
    def view_name(self) -> str:
        return self.name or f"source_{self.source_id}"


def guess_kind(uri: str) -> str:
    lowered = uri.lower()
    if lowered.startswith(POSTGRES_SCHEMES):
        return POSTGRES
    return next((kind for ending, kind in KIND_BY_ENDING.items() if lowered.endswith(ending)), UNKNOWN)


def hadoop_path(uri: str) -> str:
    """The path as the Hadoop connectors name it: s3 is read through s3a."""
    return "s3a://" + uri[5:] if uri.lower().startswith("s3://") else uri


def extension(uri: str) -> str:
    return PurePosixPath(uri.lower()).suffix


@dataclass(frozen=True)
class PostgresTable:
    url: str
    schema: str
    table: str
    properties: Mapping[str, str]

    @property
    def dbtable(self) -> str:
        return f"{self.schema}.{self.table}"


def parse_postgres(uri: str) -> PostgresTable:
    """Split ``postgresql://user:password@host/db::schema.table`` for a JDBC read."""
    if TABLE_MARK not in uri:
        raise LoadError(f"a Postgres URI must end in '{TABLE_MARK}schema.table': {uri}")
    connection, reference = uri.split(TABLE_MARK, 1)
    schema, dot, table = reference.partition(".")
    if not dot:
        schema, table = DEFAULT_SCHEMA, reference
    if not table or "." in table:
        raise LoadError(f"cannot read a table name from '{reference}'")
    parts = urlsplit(connection)
    host = parts.hostname or "localhost"
    place = f"{host}:{parts.port}" if parts.port else host
    properties = {"driver": "org.postgresql.Driver"}
    if parts.username:
        properties["user"] = unquote(parts.username)
    if parts.password:
        properties["password"] = unquote(parts.password)
    query = f"?{parts.query}" if parts.query else ""
    return PostgresTable(f"jdbc:postgresql://{place}{parts.path}{query}", schema, table, properties)
