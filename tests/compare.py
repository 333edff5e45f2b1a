"""Run every query against its SQL: `python tests/compare.py [folder] [query ...]`."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(spark, con, folder, name):
    """None if equal, else what differs."""
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in entry.oracle_sql():
        return None if got[1] else "no rows"
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return None
    odd = next(((g, w) for g, w in zip(got[1], want[1]) if g != w), None)
    return f"columns {got[0]} / {want[0]}; rows {len(got[1])} / {len(want[1])}; first difference {odd}"


if __name__ == "__main__":
    from sourceloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = oracle(folder)
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            result = difference(spark, con, folder, name)
        except Exception as problem:  # noqa: BLE001
            result = f"{type(problem).__name__}: {str(problem)[:600]}"
        kind = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{'ok  ' if result is None else 'FAIL'} {time.time() - start:6.2f}s {name}{kind} {result or ''}"[:1500], flush=True)
