"""Compare catalogue queries with their DuckDB oracles (row count, column
names, order-insensitive values).  Also a CLI:

    python tests/oracle_helpers.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "toArray"):
        return tuple(round(float(x), 6) for x in v.toArray())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def value_hash(counter: Counter) -> str:
    h = hashlib.sha256()
    for row in sorted(counter.items(), key=repr):
        h.update(repr(row).encode())
    return h.hexdigest()[:16]


# Spark simpleString type -> DuckDB type name for the types the catalogue uses
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


def type_mismatches(sdf, rel) -> list:
    spark_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for col, st in spark_types.items():
        dt = duck_types.get(col)
        if dt is not None and SPARK_TO_DUCK.get(st, st) != dt:
            out.append((col, st, dt))
    return out


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    t2 = time.time()
    s_cnt, d_cnt = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    result = {
        "name": name,
        "rows": (len(s_rows), len(d_rows)),
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "values_match": s_cnt == d_cnt,
        "spark_sec": round(t1 - t0, 2),
        "duck_sec": round(t2 - t1, 2),
    }
    result["type_mismatches"] = type_mismatches(sdf, rel)
    result["ok"] = (result["columns_match"] and result["values_match"] and len(s_rows) == len(d_rows)
                    and not result["type_mismatches"])
    if not result["columns_match"]:
        result["columns"] = (sorted(s_cols), sorted(d_cols))
    elif not result["values_match"]:
        only_s = list((s_cnt - d_cnt).items())[:3]
        only_d = list((d_cnt - s_cnt).items())[:3]
        result["diff"] = {"spark_only": only_s, "duck_only": only_d,
                          "columns": sorted(s_cols)}
    return result


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from attrix.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        if name not in oracles:
            t0 = time.time()
            n = queries[name](spark, sf_dir).count()
            print({"name": name, "rows_only": n, "spark_sec": round(time.time() - t0, 2)}, flush=True)
            continue
        try:
            res = compare(spark, con, name, queries[name], oracles[name], sf_dir)
        except Exception as exc:  # report and continue
            res = {"name": name, "ok": False, "error": repr(exc)[:500]}
        bad += not res["ok"]
        print(res, flush=True)
    print(f"FAILED: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
