"""Rows of a query against the rows of its SQL."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

# Spark and DuckDB names of one type
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def sql_rows(con, sql: str):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = [str(c[1]) for c in result.description]
    return names, types, result.fetchall()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def differences(df, con, sql: str) -> str | None:
    names, types, expected = sql_rows(con, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = dict(df.dtypes)
    wrong = [(n, kinds[n], t) for n, t in zip(names, types) if SAME_TYPE.get(kinds[n]) != t]
    if wrong:
        return f"types differ: {wrong}"
    rows = df.select(*names).collect()
    found = Counter(tuple(map(canonical, r)) for r in rows)
    wanted = Counter(tuple(map(canonical, r)) for r in expected)
    if found != wanted:
        extra, missing = found - wanted, wanted - found
        return (f"{len(rows)} rows, {len(expected)} expected; extra {str(list(extra)[:2])[:600]}; "
                f"missing {str(list(missing)[:2])[:600]}")
    return None
