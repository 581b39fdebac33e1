"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return plain(float(value))
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r),
    )


def compare(spark, query, sql, sf_dir):
    """None when equal, else a short description of the first difference."""
    frame = query(spark, sf_dir)
    relation = duck(sf_dir).sql(sql)
    if sorted(frame.columns) != sorted(relation.columns):
        return f"columns {sorted(frame.columns)} / {sorted(relation.columns)}"
    types = dict(zip(relation.columns, map(str, relation.types)))
    uneven = {
        f.name: (f.dataType.simpleString(), types[f.name])
        for f in frame.schema
        if TYPES.get(f.dataType.simpleString()) != types[f.name]
    }
    if uneven:
        return f"types {uneven}"
    ours = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    theirs = canonical(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first difference\n  spark  {str(a)[:600]}\n  duckdb {str(b)[:600]}"
    return None
