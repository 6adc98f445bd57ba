"""Run registered queries next to their SQL statements and compare whole results.

    python tests/compare.py [sf folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(frame):
    frame = frame[sorted(frame.columns)]
    def shown(v):
        if v is None or v is pd.NA or v != v:
            return "∅"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    for name in frame.columns:  # whole numbers with nulls are floats on one side only
        if str(frame[name].dtype) in ("Int64", "Int32"):
            frame = frame.astype({name: "float64"})
    rows = [tuple(map(shown, r)) for r in frame.itertuples(index=False)]
    return list(frame.columns), sorted(rows)


def check(spark, con, folder: str, name: str, fn, sql: str | None):
    """(ok, message, seconds in Spark)."""
    start = time.time()
    got = canon(fn(spark, folder).toPandas())
    took = time.time() - start
    if sql is None:
        return True, f"{len(got[1])} rows, no SQL", took
    want = canon(con.execute(sql).fetch_df())
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}", took
    if got[1] == want[1]:
        return True, f"{len(got[1])} rows", took
    a, b = set(got[1]), set(want[1])
    return False, (f"{len(got[1])} vs {len(want[1])} rows; only spark {len(a - b)} {list(a - b)[:2]}; "
                   f"only sql {len(b - a)} {list(b - a)[:2]}"), took


def main() -> int:
    import __spark_entry__ as contract
    from spanwright.session import build_session

    queries, statements = contract.queries(), contract.oracle_sql()

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(queries)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = database(folder), 0
    for name in names:
        try:
            start = time.time()
            ok, message, took = check(spark, con, folder, name, queries[name], statements.get(name))
        except Exception as e:  # report and go on with the next query
            ok, message, took = False, f"{type(e).__name__}: {str(e)[:1200]}", time.time() - start
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s {message}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
