"""Run registered jobs on Spark and their oracle SQL on DuckDB; compare.

Usage: python tools/oracle_check.py [--sf DIR] [names...]

Comparison: same column names (sorted), same row count, and the same multiset
of rows after values are normalised (floats rounded to 6 decimals, times to
ISO text). Exits non-zero when any job differs.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# STRICT=1 compares floats bit for bit instead of at 6 decimals.
STRICT = os.environ.get("STRICT") == "1"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if STRICT else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


# Spark simple type -> DuckDB type name, for the schema comparison.
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def rows_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = sdf.collect()
    t1 = time.time()
    scols = sdf.columns
    if sql is None:
        return dict(name=name, status="no-sql", rows=len(srows), spark_s=round(t1 - t0, 2))
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    t2 = time.time()
    res = dict(name=name, rows=len(srows), oracle_rows=len(drows), spark_s=round(t1 - t0, 2),
               duck_s=round(t2 - t1, 2))
    if sorted(scols) != sorted(dcols):
        res.update(status="columns", spark_cols=scols, oracle_cols=dcols)
        return res
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    sn = rows_key([tuple(norm(r[i]) for i in si) for r in srows])
    dn = rows_key([tuple(norm(r[i]) for i in di) for r in drows])
    if len(sn) != len(dn):
        res.update(status="rowcount")
        return res
    bad = [(a, b) for a, b in zip(sn, dn) if a != b]
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    tbad = [(c, stypes[c], dtypes[c]) for c in order if TYPE_NAMES.get(stypes[c], stypes[c]) != dtypes[c]]
    if bad:
        res.update(status="values", n_bad=len(bad), first=bad[:3], cols=order)
    elif tbad:
        res.update(status="types", types=tbad)
    else:
        res.update(status="ok")
    return res


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from tessera.session import get_session
    from tessera.plans import ORACLE, QUERIES
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(a.sf)
    names = a.names or list(QUERIES)
    failed = 0
    for n in names:
        try:
            r = compare(spark, con, n, QUERIES[n], ORACLE.get(n), a.sf)
        except Exception as e:  # report and go on with the next job
            r = dict(name=n, status="error", error=str(e).splitlines()[0][:400])
        if r["status"] not in ("ok", "no-sql"):
            failed += 1
        print(r, flush=True)
    print(f"{len(names) - failed}/{len(names)} ok", flush=True)
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
