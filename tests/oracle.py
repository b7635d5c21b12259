"""Run a registered query on Spark and its SQL twin on DuckDB and compare them.

    python tests/oracle.py [sf] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def sort_key(row):
    return tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in row)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(row[i]) for i in order) for row in rows), key=sort_key)


def compare(spark, con, sf_dir, name, build, sql):
    df = build(spark, sf_dir)
    sn, sr = normal(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    dn, dr = normal([d[0] for d in cur.description], cur.fetchall())
    if sn != dn:
        return f"columns differ: {sn} vs {dn}"
    if len(sr) != len(dr):
        return f"rows differ: spark {len(sr)} duckdb {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b or [isinstance(x, float) for x in a] != [isinstance(x, float) for x in b]]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, first:\n   spark {bad[0][0]}\n   duck  {bad[0][1]}\n   cols {sn}"
    return None if sr else "EMPTY"


def main():
    from waypoint.plans import all_queries
    from waypoint.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    spark = build_session("local[8]")
    builds, sqls = all_queries()
    sf_dir = f"{DATA}/sf{sf}"
    con = duck(sf_dir)
    failed = []
    for name, build in builds.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                why = compare(spark, con, sf_dir, name, build, sqls[name])
            else:
                rows = build(spark, sf_dir).collect()
                why = None if rows else "EMPTY"
        except Exception as e:  # report and go on with the next query
            why = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - t:.1f}s {why or ''}", flush=True)
        if why:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
