"""Run registered queries against their DuckDB twins and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares column names, row count and an order-insensitive canonical form
of the values (floats at 6 decimals).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402,F401

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(v):
    if v is None:
        return "NULL"
    try:
        import pandas as pd
        if v is pd.NaT:
            return "NULL"
    except Exception:
        pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item"):
        return _canon(v.item())
    if isinstance(v, int):
        return f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _canon(v.tolist())
    return str(v)


def canon_rows(pdf):
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(tuple(_canon(x) for x in rec))
    rows.sort()
    return cols, rows


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sp = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(sp), "spark_s": round(t1 - t0, 2)}
    dk = con.sql(sql).df()
    c1, r1 = canon_rows(sp)
    c2, r2 = canon_rows(dk)
    ok = c1 == c2 and r1 == r2
    info = {"name": name, "ok": ok, "rows": len(sp), "oracle_rows": len(dk),
            "spark_s": round(t1 - t0, 2)}
    if not ok:
        info["cols"] = (c1, c2) if c1 != c2 else None
        diff1 = [r for r in r1 if r not in set(r2)][:3]
        diff2 = [r for r in r2 if r not in set(r1)][:3]
        info["only_spark"] = diff1
        info["only_oracle"] = diff2
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from ledgerlens.session import build_session
    import __spark_entry__ as entry
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs = entry.queries()
    orc = entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            info = compare(spark, con, name, fn, orc.get(name), sf_dir)
        except Exception as e:  # report and go on
            info = {"name": name, "ok": False, "error": repr(e)[:800]}
        if info.get("ok") is False:
            bad += 1
        print(info, flush=True)
    print(f"FAILED: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
