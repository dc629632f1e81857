"""Compare registered queries with their SQL on one folder of tables.

Usage: python tests/oracle.py <folder> [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_norm(r[i]) for i in at) for r in rows), key=repr)


def compare(df, con, sql) -> str | None:
    """``None`` when both sides agree, else what differs."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    a_cols, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b_cols, b = rows_of(names, cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(p) for p in x] != [type(q) for q in y]]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as e
    from conftest import session
    spark = session()
    folder, wanted = sys.argv[1], sys.argv[2:]
    con = connect(folder)
    failed = []
    for name, fn in e.queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            sql = e.oracle_sql().get(name)
            verdict = compare(df, con, sql) if sql else f"no sql, {df.count()} rows"
        except Exception as ex:  # noqa: BLE001
            verdict = f"{type(ex).__name__}: {str(ex)[:600]}"
        spark.catalog.clearCache()
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - t:.1f}s {verdict or ''}", flush=True)
        if verdict:
            failed.append(name)
    print("failed:", failed)
