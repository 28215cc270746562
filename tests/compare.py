"""Run every query beside its SQL counterpart and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark, connection, name, run, sql, sf_dir):
    """None if equal, else a description of the difference."""
    started = time.perf_counter()
    df = run(spark, sf_dir)
    columns, rows = df.columns, [tuple(r) for r in df.collect()]
    spent = time.perf_counter() - started
    if sql is None:
        return spent, len(rows), None
    result = connection.execute(sql)
    other_columns = [d[0] for d in result.description]
    other = result.fetchall()
    if sorted(columns) != sorted(other_columns):
        return spent, len(rows), f"columns {sorted(columns)} / {sorted(other_columns)}"
    left, right = rows_of(columns, rows), rows_of(other_columns, other)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        return spent, len(rows), f"rows {len(left)}/{len(right)} spark {only_left} sql {only_right}"
    return spent, len(rows), None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from tidemark.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    connection, sqls = oracle(sf_dir), oracle_sql()
    bad = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            spent, count, problem = compare(spark, connection, name, run, sqls.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            spent, count, problem = 0.0, -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if name in sqls else "rows")
        print(f"{mark:5}{name:28}{count:8} rows {spent:6.2f} s {problem or ''}", flush=True)
    print("failed", bad)
