"""Run a registered query and its SQL on the same files and compare every cell."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SAME_TYPE = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What is not equal, in words; empty if all is."""
    con_result = con.execute(sql)
    sql_columns = [d[0] for d in con_result.description]
    sql_types = {d[0]: str(d[1]) for d in con_result.description}
    sql_rows = con_result.fetchall()
    problems = []
    if sorted(df.columns) != sorted(sql_columns):
        return [f"columns {sorted(df.columns)} != {sorted(sql_columns)}"]
    for name, kind in df.dtypes:
        if sql_types[name] not in SAME_TYPE.get(kind, set()):
            problems.append(f"type of {name}: {kind} != {sql_types[name]}")
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows_of(sql_columns, sql_rows)
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    unequal = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if unequal:
        problems.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    return problems
