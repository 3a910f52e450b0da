"""Compares a Spark query with DuckDB SQL over the same tables."""

import glob
import math
import os

import duckdb


def _key(row):
    return tuple((x is None, round(x, 9) if isinstance(x, float) else x) for x in row)


def differs(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.sql(sql)
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    if columns != sorted(want.columns):
        return f"columns {columns} and {sorted(want.columns)}"
    order = [want.columns.index(c) for c in columns]
    a = sorted(map(_key, (tuple(r) for r in got.select(*columns).collect())), key=repr)
    b = sorted(map(_key, (tuple(r[i] for i in order) for r in want.fetchall())), key=repr)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    same = lambda x, y: x == y or isinstance(x[1], float) and isinstance(y[1], (int, float)) and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=1e-9)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(same(i, j) for i, j in zip(x, y, strict=True))]
    return f"{len(bad)} rows, first {bad[0]}" if bad else ""
