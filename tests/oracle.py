"""Run every query next to its SQL: python tests/oracle.py [--large] [folder] [name ...]"""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if value is None:
        return "\x00null"
    return f"{type(value).__name__}:{value}"


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def compare(spark, con, folder, name, query, sql):
    """(problem or None, seconds, rows)"""
    began = time.time()
    got = query(spark, folder)
    rows = [tuple(r) for r in got.collect()]
    seconds = time.time() - began
    if sql is None:
        return None, seconds, len(rows)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    types = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in found.description}
    want = found.fetchall()
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(names)}", seconds, len(rows)
    wrong = {n: (dict(got.dtypes)[n], types[n]) for n in names if dict(got.dtypes)[n] != types[n]}
    a, b = normal(got.columns, rows), normal(names, want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:2]
        lost = [r for r in b if r not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; only spark {str(extra)[:400]}; only sql {str(lost)[:400]}", seconds, len(rows)
    return (f"types {wrong}" if wrong else None), seconds, len(rows)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from codestrata.operators import skew
    from codestrata.session import local_session

    args = [a for a in sys.argv[1:] if a != "--large"]
    folder, picked = (args[0] if args else "/root/testdata/sf0.01"), args[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    if "--large" in sys.argv:  # the joins a cluster would plan for large sides
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        skew.HOT_ROWS = 0  # and every key with a share of the rows treated as hot
    con, sql, bad = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if picked and name not in picked:
            continue
        try:
            problem, seconds, n = compare(spark, con, folder, name, query, sql.get(name))
        except Exception as e:  # noqa: BLE001
            problem, seconds, n = f"{type(e).__name__}: {str(e)[:700]}", 0.0, 0
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok '} {name:30s} {n:8d} {seconds:6.2f}s {problem or ''}", flush=True)
    print("failed:", bad)
