"""Run a registered query and its SQL twin on the same tables and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type -> SQL engine type; results must agree on these too.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(df, con, sql: str) -> tuple[int, list[str]]:
    """Row count of the Spark result and a list of differences (empty when equal)."""
    cursor = con.execute(sql)
    described = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    names = sorted(df.columns)
    problems = []
    if names != sorted(described):
        return 0, [f"columns {names} / {sorted(described)}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != described[name]:
            problems.append(f"type of {name}: {kind} / {described[name]}")
    cursor = con.execute(sql)
    order = [d[0] for d in cursor.description]
    theirs = [tuple(_plain(r[order.index(n)]) for n in names) for r in cursor.fetchall()]
    ours = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} / {len(theirs)}")
    ours.sort(key=repr)
    theirs.sort(key=repr)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        a, b = wrong[0]
        problems.append(f"{len(wrong)} rows differ, first:\n  spark {str(a)[:1500]}\n  sql   {str(b)[:1500]}")
    return len(ours), problems
