"""Run registered queries against their DuckDB oracle (the driver's check).

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, _ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_norm(k)}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(columns[i] for i in order), sorted(tuple(_norm(r[i]) for i in order) for r in rows)]


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    t2 = time.time()
    scols, sv = rows_of(sdf.columns, srows)
    dcols2, dv = rows_of(dcols, drows)
    ok = scols == dcols2 and sv == dv
    detail = ""
    if not ok:
        if scols != dcols2:
            detail = f"cols spark={scols} duck={dcols2}"
        else:
            ss, ds = set(sv), set(dv)
            detail = f"rows spark={len(sv)} duck={len(dv)}; only spark {list(ss - ds)[:3]}; only duck {list(ds - ss)[:3]}"
    return ok, len(srows), len(drows), t1 - t0, t2 - t1, detail


def main(argv):
    plain = "--plain" in argv
    argv = [a for a in argv if a != "--plain"]
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as ent

    if plain:  # a session as the driver builds it, none of our settings
        from pyspark.sql import SparkSession

        spark = (
            SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false").getOrCreate()
        )
        print("entry rows:", ent.entry(spark).count(), flush=True)
    else:
        from grantweave.session import local_session

        spark = local_session()
    con = duck(sf_dir)
    qs, sqls = ent.queries(), ent.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        if k not in sqls:
            n = qs[k](spark, sf_dir).count()
            print(f"ROWS-ONLY {k}: {n} rows", flush=True)
            continue
        try:
            ok, ns, nd, ts, td_, detail = compare(spark, con, k, qs[k], sqls[k], sf_dir)
        except Exception as e:  # report and continue
            ok, ns, nd, ts, td_, detail = False, -1, -1, 0, 0, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {k}: spark={ns} duck={nd} ({ts:.1f}s/{td_:.1f}s) {detail}", flush=True)
    print(f"{len(keys or qs) - bad} ok, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
