"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def kind(value) -> str:
    return type(value).__name__


def both(spark, con, run, sql: str, sf_dir: str):
    """``(spark_rows, sql_rows, problems)`` with columns sorted by name and rows sorted by value."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    raw = df.select(*names).collect()
    cur = con.execute(sql)
    sql_names = [d[0] for d in cur.description]
    sql_raw = cur.fetchall()
    problems = []
    if sorted(sql_names) != names:
        return raw, sql_raw, [f"columns {names} != {sorted(sql_names)}"]
    order = [sql_names.index(n) for n in names]
    sql_types = {d[0]: str(d[1]) for d in cur.description}
    for name, spark_type in df.dtypes:
        want = SQL_TYPES.get(spark_type)
        if want != sql_types[name] and sql_types[name] != '"NULL"':
            problems.append(f"type of {name}: {spark_type} against {sql_types[name]}")
    sql_rows = [tuple(r[i] for i in order) for r in sql_raw]
    for i, n in enumerate(names):
        a = {kind(r[i]) for r in raw if r[i] is not None}
        b = {kind(r[i]) for r in sql_rows if r[i] is not None}
        if a and b and a != b:
            problems.append(f"types of {n}: {a} != {b}")
    left = sorted((tuple(map(plain, r)) for r in raw), key=repr)
    right = sorted((tuple(map(plain, r)) for r in sql_rows), key=repr)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    elif left != right:
        diff = [(a, b) for a, b in zip(left, right) if a != b]
        problems.append(f"{len(diff)} rows differ, first: {names}\n  {diff[0][0]}\n  {diff[0][1]}")
    return left, right, problems
