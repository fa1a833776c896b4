"""Compare every query with its SQL in DuckDB: ``python tests/oracle.py [folder] [names...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    """A value in a form both engines agree on."""
    if isinstance(v, decimal.Decimal):
        return f"{v.normalize():f}" if v else "0"
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes, bytearray)):
        return bytes(v) if isinstance(v, bytearray) else v
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (str(int(v)) if v == int(v) and abs(v) < 2**53 else f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def open_duckdb(folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return con


def compare(spark, con, fn, sql, folder):
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}: extra {[r for r in got if r not in set(want)][:3]} missing {[r for r in want if r not in set(got)][:3]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[:2]}" if bad else None


def main():
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_duckdb(folder)
    qs, sqls = e.queries(), e.oracle_sql()
    names = sys.argv[2:] or list(qs)
    bad = 0
    for n in names:
        t = time.time()
        try:
            problem = compare(spark, con, qs[n], sqls[n], folder) if n in sqls else f"rows only: {qs[n](spark, folder).count()}"
        except Exception as x:
            problem = f"{type(x).__name__}: {str(x)[:600]}"
        if problem:
            bad += 1
        print(f"{'BAD' if problem else 'ok '} {n} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} match")


if __name__ == "__main__":
    main()
