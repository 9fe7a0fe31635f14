"""Run every query and its SQL counterpart and compare them.

    python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def normalised(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(cells, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


def difference(frame, connection, sql: str) -> str | None:
    left_names, left = normalised(frame.columns, [tuple(row) for row in frame.collect()])
    cursor = connection.execute(sql)
    right_names, right = normalised([column[0] for column in cursor.description], cursor.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}: {left[:2]} {right[:2]}"
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first: {wrong[0]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from cardtide.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failures = connect(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            if name in oracles:
                problem = difference(frame, connection, oracles[name])
                state = "match" if problem is None else f"DIFFERS {problem}"
            else:
                state = f"rows only: {frame.count()}"
                problem = None
        except Exception as error:  # noqa: BLE001
            problem = state = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
