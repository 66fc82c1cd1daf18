"""Run a job on Spark and its SQL on DuckDB and compare rows, types and values."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KINDS = {"bigint": "int", "int": "int", "double": "double", "string": "text", "boolean": "bool",
         "smallint": "int", "tinyint": "int", "float": "double", "timestamp": "time", "date": "date"}
DUCK = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "text", "BOOLEAN": "bool",
        "FLOAT": "double", "TIMESTAMP": "time", "DATE": "date", "TIMESTAMP_NS": "time",
        "TIMESTAMP WITH TIME ZONE": "time"}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((v is None, "" if v is None else (f"{v:.3f}" if isinstance(v, float) else str(v))) for v in row)


def compare(df, con, statement: str, tol: float = 0.0) -> list[str]:
    """Differences found, empty when equal. Values must match exactly unless ``tol``."""
    cur = con.execute(statement)
    duck_cols = [d[0] for d in cur.description]
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    duck_rows = cur.fetchall()
    problems = []
    if sorted(df.columns) != sorted(duck_cols):
        return [f"columns {sorted(df.columns)} vs {sorted(duck_cols)}"]
    for name, kind in df.dtypes:
        a, b = KINDS.get(kind, kind), DUCK.get(duck_types[name], duck_types[name])
        exact = {"bigint": "BIGINT", "int": "INTEGER"}.get(kind)
        if a != b or (exact and exact != duck_types[name]):
            problems.append(f"type {name}: {kind} vs {duck_types[name]}")
    cols = sorted(df.columns)
    pos = [duck_cols.index(c) for c in cols]
    left = sorted((tuple(_norm(v) for v in r) for r in df.select(*cols).collect()), key=_key)
    right = sorted((tuple(_norm(r[p]) for p in pos) for r in duck_rows), key=_key)
    if len(left) != len(right):
        return problems + [f"rows {len(left)} vs {len(right)}"]
    bad = 0
    for a, b in zip(left, right):
        for c, x, y in zip(cols, a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tol)
            if not same:
                bad += 1
                if bad <= 3:
                    problems.append(f"{c}: {x!r} vs {y!r} in {dict(zip(cols, a))}")
                break
    if bad:
        problems.append(f"{bad} of {len(left)} rows differ")
    return problems
