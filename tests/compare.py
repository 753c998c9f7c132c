"""Compares a query's rows with DuckDB's on the same tables, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def difference(spark_df, con, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(columns)}"
    a, b = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()]), rows_of(columns, found.fetchall())
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only Spark {only_a}; only SQL {only_b}"

#: Tables for the tests.
TINY = "/root/testdata/sf0.001"
