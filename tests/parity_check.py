"""Compare every query with its SQL: ``python tests/parity_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

TYPES = {"int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    """A value in a form that is equal for equal results of both engines."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, connection, name, function, sql, sf_dir) -> str | None:
    """What differs, or None."""
    df = function(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    wanted = cursor.fetchall()
    types = {d[0]: str(d[1]).upper() for d in cursor.description}
    odd = [(c, t, types[c]) for c, t in df.dtypes if c in types and TYPES.get(t, t.upper()) != types[c]]
    if odd:
        print(f"     types differ in {name}: {odd}")
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, wanted)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}: {a[:2]} vs {b[:2]}"
    for x, y in zip(a, b):
        if repr(x) != repr(y):
            return f"{sorted(columns)}\n   got {x}\n   sql {y}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from plumbline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("parity", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failed = connect(sf_dir), oracle_sql(), 0
    for name, function in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = differences(spark, connection, name, function, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - the report goes on
            problem = "".join(traceback.format_exception_only(error))[:1500]
        failed += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:28s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
