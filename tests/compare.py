"""Compare every query with its SQL in DuckDB: ``python tests/compare.py DIR [NAME...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def _sort_key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(row[i] for i in order) for row in rows), key=_sort_key
    )


def difference(spark, connection, sf_dir: str, name: str) -> str | None:
    """None when query and SQL agree exactly, else what differs."""
    frame = entry.queries()[name](spark, sf_dir)
    got_names, got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want_names, want = _rows(names, result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    different = [(g, w) for g, w in zip(got, want) if not _same(g, w)]
    return f"{len(different)} rows differ, first {different[0]}" if different else None


def _same(a, b) -> bool:
    return all(
        x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
        for x, y in zip(a, b)
    )


if __name__ == "__main__":
    from navscore.session import build_session

    session = build_session(
        master="local[8]",
        settings={
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    duck = connect(folder)
    failed = 0
    for query in sys.argv[2:] or entry.queries():
        started = time.time()
        try:
            found = difference(session, duck, folder, query)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {query} {time.time() - started:.2f} {found or ''}")
    print("failed:", failed)
