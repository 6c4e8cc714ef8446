"""Run registered queries next to their SQL on another engine and compare every value.

    python tests/parity.py [name-part ...]      # PARITY_SF chooses the table folder
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _norm(value):
    if value is None:
        return ("n",)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        if math.isnan(value):
            return ("f", "nan")
        return ("f", repr(value + 0.0))
    if isinstance(value, int):
        return ("i", value)
    return ("s", str(value))


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql) -> str | None:
    """None when both results are equal in columns, row count and every value."""
    got = table_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want = table_rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got[1])} rows differ in {got[0]}; first {wrong[0]}"
    return None


def main(parts: list[str]) -> int:
    import __spark_entry__ as entry
    from ratelens.session import local_session

    folder = os.environ.get("PARITY_SF", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = difference(run(spark, folder), con, sql[name])
                state = "ok" if problem is None else "DIFF " + problem
            else:
                state = f"rows {len(run(spark, folder).collect())}"
                problem = None
        except Exception as exc:  # report and go on with the next query
            problem = state = f"FAIL {type(exc).__name__} {str(exc)[:1500]}"
        bad += problem is not None
        print(f"{name:36s} {time.time() - start:6.1f}s {state}", flush=True)
    print(f"{bad} problems", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
