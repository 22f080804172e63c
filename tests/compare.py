"""Runs registered queries on Spark and their SQL on DuckDB, and compares rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NULL" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, dt.datetime):
        return v.isoformat(" ")
    return "NULL" if v is None else str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in places) for r in rows)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def differences(spark, folder: str, name: str, query, sql: str) -> list[str]:
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    result = duck(folder).execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = rows_of(names, result.fetchall())
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for column, kind in df.dtypes:
        if _KINDS.get(kind, kind) != types[column]:
            problems.append(f"type of {column}: {kind} != {types[column]}")
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    if got != expected:
        missing = [r for r in expected if r not in set(got)][:3]
        extra = [r for r in got if r not in set(expected)][:3]
        problems.append(f"columns {sorted(names)} missing {missing} extra {extra}"[:1500])
    return problems
