"""Spark-versus-DuckDB comparison used by the tests and by hand.

Mirrors the driver's check: column names, row count and an
order-insensitive comparison of values (floats to 9 significant digits).
"""

from __future__ import annotations

import math
import sys

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~null",)
        if math.isinf(v):
            return ("inf", v > 0)
        return ("num", float(f"{v:.9g}"))
    if isinstance(v, bool):
        return ("num", float(v))
    if isinstance(v, int):
        return ("num", float(v))
    if hasattr(v, "tolist"):
        return ("list", tuple(_norm(x) for x in v.tolist()))
    if isinstance(v, (list, tuple)):
        return ("list", tuple(_norm(x) for x in v))
    return ("str", str(v))


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    import __spark_entry__ as E

    sdf = E.queries()[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rec = [tuple(r) for r in sdf.collect()]
    con = con or duck(sf_dir)
    rel = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in rel.description]
    d_rec = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} sql={sorted(d_cols)}"
    if len(s_rec) != len(d_rec):
        return False, f"row count spark={len(s_rec)} sql={len(d_rec)}"
    a, b = _rows(s_cols, s_rec), _rows(d_cols, d_rec)
    if a != b:
        for x, y in zip(a, b):
            if x != y:
                return False, f"first difference:\n spark={x}\n sql  ={y}"
    return True, f"{len(s_rec)} rows"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from churnlens.session import local_session
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(E.oracle_sql())
    spark = local_session()
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, sf, con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("OK  " if ok else "FAIL"), n, msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
