"""Run registered queries beside their oracle SQL: `python tests/compare.py [sf_dir] [query ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same rows; otherwise what differs."""
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    relation = con.execute(sql)
    columns = [c[0] for c in relation.description]
    kinds = {c[0]: str(c[1]) for c in relation.description}
    if sorted(columns) != names:
        return f"columns {names} / {sorted(columns)}"
    loose = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        if loose.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} / {kinds[name]}"
    order = [columns.index(c) for c in names]
    theirs = sorted(tuple(plain(row[i]) for i in order) for row in relation.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} / {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ, first {names} {wrong[0]}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from cohortlens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(queries())
    spark, con, bad = local_session(8), duck(sf_dir), 0
    for name in chosen:
        begin = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            rows = df.count()
            middle = time.time()
            found = difference(df, con, oracle_sql()[name])
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            found, rows, middle = f"{type(error).__name__}: {str(error)[:600]}", -1, time.time()
        bad += found is not None
        print(f"{name:24} {rows:7} {middle - begin:6.2f}s {time.time() - middle:6.2f}s "
              f"{'ok' if found is None else found}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} match")
