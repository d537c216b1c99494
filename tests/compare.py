"""Run a registered query on Spark and its check on DuckDB, and compare the rows."""

from __future__ import annotations

import duckdb

from ledgerframe.suite.fixtures import TABLES

TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
    "array<string>": "VARCHAR[]",
    "decimal(38,0)": "DECIMAL(38,0)",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(names, rows, columns):
    places = [names.index(c) for c in columns]
    return sorted(repr([plain(r[i]) for i in places]) for r in rows)


def compare(frame, con, sql):
    """(columns agree, types agree, rows of Spark, rows of DuckDB)"""
    columns = sorted(frame.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(names) == columns
    for c in columns:
        assert TYPES[frame.schema[c].dataType.simpleString()] == types[c], c
    return rows_of(frame.columns, frame.collect(), columns), rows_of(names, result.fetchall(), columns)
