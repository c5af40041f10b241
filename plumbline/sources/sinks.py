"""Write tables and whole report sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_rows(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write a table as JSON lines or Parquet, one object or row per record."""
    df.write.mode(mode).format(fmt).save(path)


def write_report_tables(
    tables: Mapping[str, DataFrame], folder: str, fmt: str = "json", mode: str = "errorifexists"
) -> dict[str, str]:
    """Write each table into its own dataset below ``folder``; returns the paths by name."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        write_rows(df, paths[name], fmt, mode)
    return paths
