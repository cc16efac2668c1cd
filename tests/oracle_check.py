"""Compare registered queries with their SQL twins (also a command line tool).

    python tests/oracle_check.py sf0.001 [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else round(float(v), 9)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def compare(spark, con, sf_dir, query, sql):
    """(ok, message); runs both sides and compares whole results."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got, gcols = table(df.columns, [tuple(r) for r in df.collect()])
    spent = f"spark {time.time() - t0:.2f}s "
    if sql is None:
        return True, spent + f"rows={len(got)} (no SQL)"
    cur = con.execute(sql)
    want, wcols = table([d[0] for d in cur.description], cur.fetchall())
    if gcols != wcols:
        return False, f"columns {gcols} != {wcols}"
    if got != want:
        gs, ws = set(map(repr, got)), set(map(repr, want))
        return False, (f"rows {len(got)} vs {len(want)}; only spark: {[v[:300] for v in sorted(gs - ws)[:3]]}; "
                       f"only sql: {[v[:300] for v in sorted(ws - gs)[:3]]}")
    return True, spent + f"rows={len(got)}"


def main() -> int:
    import __spark_entry__ as entry
    from mootlake.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    want = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sqls, bad = entry.queries(), entry.oracle_sql(), 0
    for name, query in queries.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t0 = time.time()
        try:
            ok, msg = compare(spark, con, sf_dir, query, sqls.get(name))
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t0:6.2f}s {msg[:900]}", flush=True)
    print("failures:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
