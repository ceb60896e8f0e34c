"""Row-for-row comparison of queries with their checking statements."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(_cell(v) for v in row) for row in df.select(*columns).collect())


def check_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    rows = Counter(tuple(_cell(row[k]) for k in order) for row in cursor.fetchall())
    return [columns[k] for k in order], rows


def difference(df, con, sql) -> str:
    """Empty when equal; otherwise what differs."""
    mine, theirs = spark_rows(df), check_rows(con, sql)
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        extra, missing = mine[1] - theirs[1], theirs[1] - mine[1]
        return (f"rows {sum(mine[1].values())} / {sum(theirs[1].values())}; only here {sum(extra.values())}: "
                f"{list(extra)[:2]}; only there {sum(missing.values())}: {list(missing)[:2]}")
    return "" if sum(mine[1].values()) else "no rows"
