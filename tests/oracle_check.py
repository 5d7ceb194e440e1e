"""Compare catalogue queries with their oracles: python tests/oracle_check.py [sf] [query ...]"""
from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sorted(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What separates the two results, empty when they are equal row for row."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _sorted(names, cursor.fetchall())
    got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    if len(got) != len(expected):
        return [f"{len(got)} rows, expected {len(expected)}"]
    return [f"{g}\n      {e}" for g, e in zip(got, expected) if repr(g) != repr(e)]


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from stockhealth.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sf}"
    con, sqls = connect(sf_dir), oracle_sql()
    failed = []
    for name, run in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name not in sqls:
                print(f"     {name} has no SQL, {run(spark, sf_dir).count()} rows", flush=True)
                continue
            found = differences(run(spark, sf_dir), con, sqls[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {len(found) or ''}", flush=True)
        for line in found[:2]:
            print("   ", line[:700])
        failed += [name] if found else []
    print(f"failed: {failed}")
