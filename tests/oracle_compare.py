"""Run registered queries next to their check SQL: python tests/oracle_compare.py [sf_dir] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT",
}


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def compare(spark, con, folder, fn, sql):
    """None when equal, else a short account of the difference; and the seconds Spark took."""
    start = time.time()
    df = fn(spark, folder)
    columns = sorted(df.columns)
    got = [tuple(_cell(r[c]) for c in columns) for r in df.collect()]
    took = time.time() - start
    kinds = {f.name: _KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if sql is None:
        return (None if got is not None else "no rows"), took, len(got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}", took, len(got)
    odd = {c: (kinds[c], types[c]) for c in columns if kinds[c] != types[c]}
    if odd:
        return f"types (spark, sql) {odd}", took, len(got)
    at = [names.index(c) for c in columns]
    want = [tuple(_cell(r[i]) for i in at) for r in rows]
    if sorted(got) == sorted(want):
        return None, took, len(got)
    a, b = set(got), set(want)
    return (
        f"rows {len(got)} vs {len(want)}; only spark {len(a - b)}: {sorted(a - b)[:2]}; only sql {len(b - a)}: {sorted(b - a)[:2]}"
    )[:3000], took, len(got)


def main():
    import __spark_entry__ as entry
    from askance.session import local_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session("checks")
    con = duck(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if len(args) > 1 and name not in args[1:]:
            continue
        try:
            problem, took, n = compare(spark, con, folder, fn, checks.get(name))
        except Exception as e:  # noqa: BLE001
            problem, took, n = f"{type(e).__name__}: {str(e)[:1500]}", 0.0, -1
        kind = "sql" if name in checks else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {kind:4} {name:24} {n:7} rows {took:6.2f}s", flush=True)
        if problem:
            bad += 1
            print("    " + problem, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
