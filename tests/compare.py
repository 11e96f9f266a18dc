"""Run registered queries next to their check SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is not None and v.__class__.__name__ == "Decimal":
        return plain(float(v))
    if isinstance(v, bool):
        return v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 1.5e-5 * max(1.0, abs(a))
    return a == b


def check(spark, con, name, fn, sql, folder):
    """None when equal, otherwise what differs."""
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        left = [r for r in got[1] if r not in set(want[1])][:2]
        right = [r for r in want[1] if r not in set(got[1])][:2]
        return f"rows {len(got[1])} != {len(want[1])}\n   spark only {left}\n   sql only   {right}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if not all(close(x, y) for x, y in zip(g, w))]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first:\n   spark {str(bad[0][0])[:900]}\n   sql   {str(bad[0][1])[:900]}"
    return None


def main(argv):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as e
    from deskmill.session import build_session
    sf = argv[0]
    folder = f"/root/testdata/sf{sf}"
    names = argv[1:]
    from pyspark.sql import SparkSession
    SparkSession.builder.config("spark.ui.showConsoleProgress", "false")
    spark = build_session("compare", master="local[8]", partitions=8, memory="6g")
    con = connect(folder)
    sqls, failed = e.oracle_sql(), []
    for name, fn in e.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            problem = check(spark, con, name, fn, sqls.get(name), folder)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - t:.1f}s {'' if name in sqls else '(rows)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
