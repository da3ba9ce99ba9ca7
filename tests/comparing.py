"""Run a registered query and its oracle and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def oracle_connection(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{directory}/{table}.parquet')"
        )
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_rows(frame):
    return sorted(frame.columns), _rows(frame.columns, [tuple(row) for row in frame.collect()])


def oracle_rows(connection, sql):
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    return sorted(names), _rows(names, result.fetchall())


def difference(frame, connection, sql) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    columns, got = spark_rows(frame)
    expected_columns, expected = oracle_rows(connection, sql)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if got != expected:
        extra = [row for row in got if row not in set(expected)][:3]
        missing = [row for row in expected if row not in set(got)][:3]
        return f"{len(got)} rows against {len(expected)}; {columns}; extra {extra}; missing {missing}"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    from scriptledger.session import build_session

    directory, *only = sys.argv[1:]
    spark = build_session(
        "compare",
        "local[8]",
        spark__sql__shuffle__partitions=8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(directory)
    statements = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            frame = query(spark, directory)
            wrong = difference(frame, connection, statements[name])
            kinds = {
                column[0]: str(column[1])
                for column in connection.execute(statements[name]).description
            }
            decimals = [c for c, kind in kinds.items() if "DECIMAL" in kind.upper()]
            note = f"{frame.dtypes} / {kinds}" if "-v" in sys.argv else ""
        except Exception as failure:
            wrong, note, decimals = f"{type(failure).__name__}: {str(failure)[:600]}", "", []
        bad += wrong is not None
        print(
            f"{'ok ' if wrong is None else 'BAD'} {name} {time.time() - start:.1f}s"
            f" {wrong or ''} {note} {'DECIMAL ' + str(decimals) if decimals else ''}",
            flush=True,
        )
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
