"""Run registered queries next to their SQL and compare all rows.

``python tests/oracle.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()

# Operators no query may need: all pairs of rows, or rows handed to Python.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def sortable(row: tuple) -> tuple:
    return tuple((value is not None, str(type(value)), str(value)) for value in row)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=sortable)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def compare(spark, connection, folder: str, name: str, function, sql: str | None) -> dict:
    started = time.perf_counter()
    df = function(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.perf_counter() - started
    result = {"name": name, "rows": len(got), "seconds": round(seconds, 2), "problems": []}
    executed = df._jdf.queryExecution().executedPlan().toString()
    for operator in UNWANTED:
        if operator in executed:
            result["problems"].append(f"plan holds {operator}")
    if sql is None:
        return result
    relation = connection.sql(sql)
    want = rows_of(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        result["problems"].append(f"columns {sorted(df.columns)} != {sorted(relation.columns)}")
        return result
    if len(got) != len(want):
        result["problems"].append(f"rows {len(got)} != {len(want)}")
    columns = sorted(df.columns)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    sql_types = dict(zip(relation.columns, map(str, relation.types)))
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    }
    for column in columns:
        if same.get(spark_types[column]) != sql_types[column]:
            result["problems"].append(f"type {column}: {spark_types[column]} / {sql_types[column]}")
    for a, b in zip(got, want):
        for i, (x, y) in enumerate(zip(a, b)):
            if x != y or type(x) is not type(y):
                kind = "inexact" if close(x, y) else "differs"
                result["problems"].append(f"{kind} {columns[i]}: {x!r} != {y!r}")
        if len(result["problems"]) > 6:
            break
    return result


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle", f"local[{os.environ.get('CPUS', '8')}]",
        spark__sql__shuffle__partitions=8, spark__driver__memory="8g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    sql = oracle_sql()
    bad = 0
    for name, function in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            result = compare(spark, connection, folder, name, function, sql.get(name))
        except Exception as problem:
            result = {"name": name, "rows": -1, "seconds": 0, "problems": [str(problem)[:400]]}
        bad += bool(result["problems"])
        kind = "rows only" if name not in sql else "ok" if not result["problems"] else "BAD"
        print(f"{kind:9} {name:28} {result['rows']:>8} rows {result['seconds']:>7}s")
        for problem in result["problems"]:
            print("    ", problem[:400])
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
