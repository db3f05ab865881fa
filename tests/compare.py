"""Compare a query with its SQL: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return ("float", value)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and the SQL, in words; empty if nothing."""
    cursor = con.execute(sql)
    names = [column[0] for column in cursor.description]
    expected, actual = rows_of(names, cursor.fetchall()), rows_of(df.columns, df.collect())
    found = []
    if sorted(names) != sorted(df.columns):
        found.append(f"columns {sorted(df.columns)} instead of {sorted(names)}")
    if expected != actual:
        more, less = actual - expected, expected - actual
        found.append(
            f"{sum(actual.values())} rows instead of {sum(expected.values())}; "
            f"unexpected {list(more)[:3]}; missing {list(less)[:3]}"
        )
    return found
