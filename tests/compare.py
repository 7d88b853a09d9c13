"""Run registered queries next to their SQL and compare the rows."""

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None
    rel = con.execute(sql)
    want, wanted = rows_of([d[0] for d in rel.description], rel.fetchall())
    if names != wanted:
        return f"columns {names} != {wanted}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} rows, want {len(want)}; extra {sorted(a - b)[:2]}; missing {sorted(b - a)[:2]}"
    return None


def main():
    from conftest import session

    import __spark_entry__ as entry

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = session(8)
    con = connect(sf)
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            diff = compare(spark, con, name, query, entry.oracle_sql().get(name), sf)
        except Exception as error:  # report, and go on with the next
            diff = f"{type(error).__name__}: {str(error)[:600]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {time.time() - t:6.1f}s {name} {diff or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
