"""Compares a query with its DuckDB oracle."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    return x.replace(tzinfo=None).isoformat() if isinstance(x, datetime.datetime) else x


def compare(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    told = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(told.columns)
    types = dict(zip(told.columns, map(str, told.types)))
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == types
    at = [told.columns.index(n) for n in names]
    key = lambda row: tuple((x is not None, x) for x in row)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=key)
    assert ours == theirs
