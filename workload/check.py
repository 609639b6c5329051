"""Compare queries with their SQL twins: python -m workload.check [folder] [name ...]."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


SQL_SECONDS: dict[str, float] = {}


def connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return f"f{v!r}"
    return f"{type(v).__name__}:{v}"


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, name, function, sql, folder):
    """None if equal, else a description of the difference."""
    df = function(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None, len(rows)
    began = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    SQL_SECONDS[name] = time.time() - began
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", len(rows)
    a, b = _normal(df.columns, rows), _normal(columns, expected)
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a = [x for x in a if x not in in_b][:3]
        only_b = [x for x in b if x not in in_a][:3]
        return f"rows {len(a)} / {len(b)}; {sorted(df.columns)} spark {only_a} sql {only_b}", len(rows)
    return None, len(rows)


def main(argv):
    from actiongrid.session import local_session
    from workload import load

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = load()
    names = argv[1:] or list(queries)
    spark = local_session(8, "check")
    con = connection(folder)
    bad = 0
    for name in names:
        began = time.time()
        try:
            problem, n = compare(spark, con, name, queries[name], oracles.get(name), folder)
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += problem is not None
        state = "ok  " if problem is None else "BAD "
        kind = "sql" if name in oracles else "rows"
        print(f"{state} {name:28s} {kind:4s} rows={n:<8d} {time.time() - began:6.2f}s (sql {SQL_SECONDS.get(name, 0):.2f}s) {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
