"""Compare registered Spark queries with their DuckDB text."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    return str(v)


def compare(spark_df, con, sql: str) -> tuple[bool, str, int]:
    rows = spark_df.collect()
    cols = spark_df.columns
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    if sorted(cols) != sorted(dcols):
        return False, f"columns {sorted(cols)} vs {sorted(dcols)}", len(rows)
    so = sorted(range(len(cols)), key=lambda i: cols[i])
    do = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = sorted(tuple(norm(r[i]) for i in so) for r in rows)
    b = sorted(tuple(norm(r[i]) for i in do) for r in drows)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}; first {a[:2]} vs {b[:2]}", len(rows)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ; {sorted(cols)} spark={bad[0][0]} duck={bad[0][1]}", len(rows)
    return True, "", len(rows)


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from boardlake.plans import all_queries
    from boardlake.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    import logging
    logging.disable(logging.CRITICAL)
    spark = build_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    q, o = all_queries()
    bad = 0
    for name, fn in q.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in o:
                ok, why, n = compare(df, con, o[name])
            else:
                n = df.count()
                ok, why = n > 0, "rows only"
            if n == 0:
                ok, why = False, "no rows"
        except Exception as e:  # report and go on
            ok, why, n = False, f"{type(e).__name__}: {str(e)[:400]}", -1
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} rows={n:<7d} {time.time() - t0:6.2f}s {why}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
