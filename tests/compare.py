"""Runs a query and its DuckDB SQL on the same tables and compares their rows."""

from __future__ import annotations

import os

import duckdb


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def both(spark, name, query, sql, folder):
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for file in os.listdir(folder):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    found = con.sql(sql)
    assert sorted(found.columns) == columns, name
    at = [found.columns.index(c) for c in columns]
    return mine, sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
