"""Ask SQL questions over registered sources."""

from __future__ import annotations

from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from plumbline.errors import QueryError
from plumbline.sources.readers import read_source
from plumbline.sources.spec import SourceSpec

# Fixed value: the most rows that ``rows`` brings to the driver unless the caller says otherwise.
DRIVER_ROWS = 10_000


class SqlViews:
    """Registered sources as temporary views of one session.

    Queries return all their rows; ``row_cap`` cuts them where a caller asks for it.
    """

    def __init__(self, spark: SparkSession, row_cap: int | None = None):
        self.spark = spark
        self.row_cap = row_cap
        self._uris: dict[str, str] = {}

    def register(self, source: SourceSpec) -> str:
        """Make a source a view and return the view's name.

        A Parquet source costs its footers. Text sources without types of their
        own are read once to find these (CSV, TSV, JSON), and every query parses
        the text again; register a written copy where that matters.
        """
        return self.register_frame(source.view_name, read_source(self.spark, source), source.uri)

    def register_frame(self, name: str, df: DataFrame, uri: str = "") -> str:
        df.createOrReplaceTempView(name)
        self._uris[name] = uri
        return name

    def query(self, sql: str, row_cap: int | None = -1) -> DataFrame:
        """The result of ``sql``, at most ``row_cap`` rows (the session's cap unless given; None for all)."""
        cap = self.row_cap if row_cap == -1 else row_cap
        try:
            df = self.spark.sql(sql)
        except PySparkException as error:
            raise QueryError(f"query failed: {error}") from error
        return df if cap is None else df.limit(cap)

    def rows(self, sql: str, most: int = DRIVER_ROWS) -> list[tuple[Any, ...]]:
        """All rows as tuples, for small results; a result of more than ``most`` rows is an error."""
        try:
            found = [tuple(r) for r in self.spark.sql(sql).limit(most + 1).collect()]
        except PySparkException as error:
            raise QueryError(f"query failed: {error}") from error
        if len(found) > most:
            raise QueryError(f"the result has more than {most} rows; use query() instead")
        return found

    def sample(self, view: str, n: int = 5) -> DataFrame:
        return self._table(view).limit(n)

    def row_count(self, view: str) -> int:
        return self._table(view).count()

    def column_names(self, view: str) -> list[str]:
        return self._table(view).columns

    def views(self) -> list[str]:
        return list(self._uris)

    def _table(self, view: str) -> DataFrame:
        try:
            return self.spark.table(view)
        except PySparkException as error:
            raise QueryError(f"unknown view {view}: {error}") from error
