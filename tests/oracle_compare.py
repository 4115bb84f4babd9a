"""Spark-vs-DuckDB comparison used by the tests and by hand.

Usage: ``python tests/oracle_compare.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (bool, int, str)):
        return v
    return str(v)


def rows_of(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [r.asDict() for r in sdf.collect()]
    t_spark = time.time() - t0
    s_cols = sorted(sdf.columns)
    res = con.execute(sql)
    d_cols_raw = [d[0] for d in res.description]
    d_rows = [dict(zip(d_cols_raw, r)) for r in res.fetchall()]
    d_cols = sorted(d_cols_raw)
    out = {"name": name, "spark_rows": len(s_rows), "sql_rows": len(d_rows), "spark_sec": round(t_spark, 2)}
    if s_cols != d_cols:
        out["ok"] = False
        out["why"] = f"columns {s_cols} vs {d_cols}"
        return out
    a, b = rows_of(s_rows, s_cols), rows_of(d_rows, d_cols)
    out["ok"] = a == b
    if not out["ok"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["why"] = f"first diffs {diff}" if diff else "row count"
    return out


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from ibex.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sq = queries(), oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sq:
            df = qs[name](spark, sf_dir)
            n = df.count()
            print({"name": name, "rows_only": n})
            continue
        r = compare(spark, con, name, qs[name], sq[name], sf_dir)
        bad += not r["ok"]
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main(sys.argv)
