"""Run a query in Spark and its twin in DuckDB, and compare values without regard to row order."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}" if isinstance(value, float) and not float(value).is_integer() else str(int(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a description of the difference."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return None
    if len(actual) != len(expected):
        return f"{len(actual)} rows != {len(expected)}"
    bad = [(a, b) for a, b in zip(actual, expected) if a != b]
    return f"{len(bad)} rows differ, first: spark {bad[0][0]} duckdb {bad[0][1]}"
