"""Run each registered query in Spark and its DuckDB twin; compare like the driver.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SPARK_TO_CANON = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT",
                  "tinyint": "TINYINT", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE",
                  "timestamp_ntz": "TIMESTAMP"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(v, strict: bool):
    import pandas as pd
    try:
        if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)):
            return (0, "")
    except (TypeError, ValueError):
        pass
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        if v.is_integer() and abs(v) < 2**53:
            return (2, str(int(v)))
        return (1, repr(v) if strict else f"{v:.6g}")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return canon(v.item(), strict)
        except Exception:
            pass
    return (2, str(v))


def rows_of(df_pd, cols, strict):
    out = []
    for rec in df_pd[cols].itertuples(index=False, name=None):
        out.append(tuple(canon(x, strict) for x in rec))
    out.sort()
    return out


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_types = {f.name: SPARK_TO_CANON.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields}
    spd = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return dict(name=name, status="rows-only", rows=len(spd), spark_s=round(t1 - t0, 2))
    rel = con.sql(sql)
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    dpd = rel.df()
    t2 = time.time()
    res = dict(name=name, rows=len(spd), oracle_rows=len(dpd), spark_s=round(t1 - t0, 2),
               duck_s=round(t2 - t1, 2))
    if sorted(spd.columns) != sorted(dpd.columns):
        res["status"] = f"COLUMNS spark={sorted(spd.columns)} duck={sorted(dpd.columns)}"
        return res
    type_diff = {c: (s_types[c], d_types[c]) for c in s_types if s_types[c] != d_types.get(c)}
    cols = sorted(spd.columns)
    if len(spd) != len(dpd):
        res["status"] = "ROWCOUNT"
        return res
    a, b = rows_of(spd, cols, False), rows_of(dpd, cols, False)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = "VALUES"
        res["diff"] = diffs
        res["cols"] = cols
        return res
    sa, sb = rows_of(spd, cols, True), rows_of(dpd, cols, True)
    res["status"] = "OK" if sa == sb else "OK~"  # OK~: equal to 6 significant digits only
    if sa != sb:
        res["diff"] = [(x, y) for x, y in zip(sa, sb) if x != y][:2]
    if type_diff:
        res["types"] = type_diff
    return res


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    from quire.session import build_session
    import __spark_entry__ as E

    spark = build_session()
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    names = args or list(qs)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, qs[n], ors.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = dict(name=n, status="ERROR", error=str(e)[:1500])
        if r["status"] not in ("OK", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} clean")


if __name__ == "__main__":
    main()
