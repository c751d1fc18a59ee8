"""Runs a registered query next to its SQL and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return value


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    key = lambda row: [(v is None, round(v, 5) if isinstance(v, float) else v) if v is not None else (True, 0) for v in row]
    return sorted(columns), sorted(out, key=lambda r: [(k[0], str(type(k[1]).__name__ in ("str",)), k[1]) for k in key(r)])


def compare(left, right) -> str | None:
    """None if equal, else what differs. Floats must agree exactly after the queries' own rounding."""
    (lc, lr), (rc, rr) = left, right
    if lc != rc:
        return f"columns {lc} != {rc}"
    if len(lr) != len(rr):
        return f"{len(lr)} rows != {len(rr)}"
    bad = [(a, b) for a, b in zip(lr, rr) if a != b]
    return None if not bad else f"{len(bad)} of {len(lr)} rows differ, first {lc}: {bad[0][0]} != {bad[0][1]}"


def check(spark, con, sf_dir: str, name: str, fn, sql: str) -> str | None:
    df = fn(spark, sf_dir)
    got = table([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return compare(got, table(cur.fetchall(), columns))


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from rainloom.session import local_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    every, sqls = queries(), oracle_sql()
    names = [n for n in every if not sys.argv[2:] or any(p in n for p in sys.argv[2:])]
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in sqls:
                problem = check(spark, con, sf, name, every[name], sqls[name])
            else:
                rows = every[name](spark, sf).collect()
                problem = None if rows else "no rows"
                print(name, len(rows), rows[:3]) if "-v" in sys.argv else None
        except Exception as e:  # reported per query, so one failure does not hide the others
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {'' if name in sqls else '(rows only) '}{problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
