"""Runs a query on Spark and its SQL on DuckDB, over the same tables, and compares rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if path.is_file() else f'{path}/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def rows_of_duckdb(con, sql):
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def difference(df, con, sql):
    """None if the rows agree, else a short account."""
    names, ours = rows_of_spark(df)
    others, theirs = rows_of_duckdb(con, sql)
    if names != others:
        return f"columns {names} and {others}"
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs))[:2]}; only there {list((theirs - ours))[:2]}"
    return None
