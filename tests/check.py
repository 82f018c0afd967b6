"""Compare named queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        if os.path.exists(f"{sf_dir}/{table}.parquet"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def _sorted(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def differences(df, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when columns, row count and all values agree."""
    cursor = connection.execute(sql)
    names = [c[0] for c in cursor.description]
    want_columns, want = _sorted(names, cursor.fetchall())
    have_columns, have = _sorted(df.columns, [tuple(row) for row in df.collect()])
    if have_columns != want_columns:
        return [f"columns {have_columns} != {want_columns}"]
    if len(have) != len(want):
        return [f"rows {len(have)} != {len(want)}"]
    wrong = [(a, b) for a, b in zip(have, want) if a != b]
    return [f"{len(wrong)} rows differ, e.g. {a} != {b}" for a, b in wrong[:1]]


def main(sf_dir: str, names: list[str]) -> int:
    from cardwatch.catalog import ORACLE, QUERIES
    from cardwatch.session import build_session

    spark = build_session(
        "check", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8", spark__driver__memory="16g",
        spark__sql__session__timeZone=os.environ.get("CHECK_TIME_ZONE", "UTC"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = connect(sf_dir), 0
    for name in names or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            found = differences(df, connection, ORACLE[name]) if name in ORACLE else ([] if df.collect() else ["no rows"])
        except Exception as error:
            text = traceback.format_exc() if os.environ.get("TRACE") else str(error)
            found = [f"{type(error).__name__}: {text[:1500]}"]
        failed += bool(found)
        state = "ok  " if not found else "FAIL"
        print(f"{state} {time.time() - started:6.1f}s {'' if name in ORACLE else '(rows only) '}{name} {' '.join(found)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
