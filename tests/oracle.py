"""Run a registered Spark query and its DuckDB twin and compare results.

Columns are sorted by name, floats rounded to 6 places, rows sorted, so
the comparison is order-insensitive like the driver's check.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        if math.isinf(v):
            return (1, "inf" if v > 0 else "-inf")
        r = round(v, 6)
        return (1, repr(0.0 if r == 0 else r))
    if isinstance(v, bool):
        return (1, repr(int(v)))
    if isinstance(v, int):
        return (1, repr(v))
    if isinstance(v, dt.datetime):
        return (1, v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return (1, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (1, repr([_norm(x) for x in v]))
    if hasattr(v, "asDict"):
        return (1, repr(sorted((k, _norm(x)) for k, x in v.asDict().items())))
    if isinstance(v, dict):
        return (1, repr(sorted((k, _norm(x)) for k, x in v.items())))
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return _norm(float(v))
    except Exception:
        pass
    return (1, str(v))


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, out


def spark_rows(df):
    rows = df.collect()
    return list(df.columns), [tuple(r) for r in rows]


def duck_rows(con, sql):
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    return cols, res.fetchall()


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sc, sr = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    dc, dr = duck_rows(con, sql)
    c1, r1 = canon(sc, sr)
    c2, r2 = canon(dc, dr)
    ok = c1 == c2 and r1 == r2
    info = {"name": name, "ok": ok, "spark_rows": len(sr), "duck_rows": len(dr),
            "spark_sec": round(t1 - t0, 2)}
    if not ok:
        info["spark_cols"] = c1
        info["duck_cols"] = c2
        diff = [(a, b) for a, b in zip(r1, r2) if a != b][:2]
        info["first_diff"] = diff
    return info


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from wattlane.session import get_spark

    sf_dir = "/root/testdata/sf0.01"
    only = set(argv[1:])
    spark = get_spark("local[8]", 8)
    import os
    if os.environ.get("WATTLANE_TEST_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["WATTLANE_TEST_TZ"])
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        if name not in sqls:
            if os.environ.get("WATTLANE_SQL_ONLY"):
                continue
            t0 = time.time()
            try:
                n = fn(spark, sf_dir).count()
                print(f"ROWS {name}: {n} rows {time.time() - t0:.1f}s", flush=True)
            except Exception as e:
                bad += 1
                print(f"FAIL {name}: {type(e).__name__}: {str(e)[:300]}", flush=True)
            continue
        try:
            info = compare(spark, con, name, fn, sqls[name], sf_dir)
        except Exception as e:
            bad += 1
            print(f"ERR  {name}: {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        if not info["ok"]:
            bad += 1
        print(("OK   " if info["ok"] else "DIFF ") + str(info), flush=True)
    print(f"done, {bad} bad")


if __name__ == "__main__":
    main(sys.argv)
