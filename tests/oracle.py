"""Compares a registered query with its SQL in DuckDB on the driver's tables."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def differences(df, sql: str, sf_dir: str, show: int = 3) -> list[str]:
    """What differs between the rows of df and of sql, as a bag; nothing if they agree."""
    columns = sorted(df.columns)
    ours = sorted((repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()))
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return [f"columns {columns} against {sorted(names)}"]
    at = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())
    if ours == theirs:
        return []
    a, b = [x for x in ours if x not in set(theirs)], [x for x in theirs if x not in set(ours)]
    return [f"{len(ours)} rows against {len(theirs)}", *[f"only ours: {x[:400]}" for x in a[:show]], *[f"only SQL: {x[:400]}" for x in b[:show]]]
