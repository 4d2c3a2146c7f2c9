"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return (0,)
    if isinstance(v, bool):
        return (1, float(v))
    if isinstance(v, (int, float)):
        return (1, 0.0 if math.isnan(v) else float(f"{float(v):.10g}"))
    if isinstance(v, (list, tuple)):
        return (3, tuple(plain(x) for x in v))
    if isinstance(v, dict):
        return (3, tuple(plain(x) for x in v.values()))
    if hasattr(v, "__float__"):
        return (1, float(f"{float(v):.10g}"))
    return (2, str(v))


def difference(spark, query, sql, sf_dir, con=None):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    con = con or connect(sf_dir)
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in order) for r in (x.asDict(recursive=True) for x in df.collect()))
    at = [names.index(c) for c in order]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return None if got else "no rows"
    more = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows; {order}; only Spark {more[0]}; only SQL {more[1]}"
