"""Runs queries of the entry file beside their SQL oracles: python tests/oracle_compare.py DIR [NAME ...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def cell(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if hasattr(x, "item"):
        return cell(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    return x


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, d, query, sql):
    df = query(spark, d)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    return got, want


if __name__ == "__main__":
    from conftest import make_spark

    import __spark_entry__ as e
    from derivagraph.scratch import close_all

    d, names = sys.argv[1], sys.argv[2:]
    spark, con, q, o = make_spark(), connect(d), e.queries(), e.oracle_sql()
    bad = 0
    for n in names or sorted(q):
        t = time.time()
        try:
            if n not in o:
                print(f"{n}: {q[n](spark, d).count()} rows, no oracle, {time.time() - t:.1f} s", flush=True)
                continue
            got, want = compare(spark, con, d, q[n], o[n])
            ok = got == want
            bad += not ok
            print(f"{'ok  ' if ok else 'DIFF'} {n}: {len(got[1])} rows, {time.time() - t:.1f} s", flush=True)
            if not ok:
                a, b = set(map(repr, got[1])), set(map(repr, want[1]))
                print("   columns", got[0], want[0], "rows", len(got[1]), len(want[1]))
                print("   only ours", sorted(a - b)[:3], "\n   only oracle", sorted(b - a)[:3], flush=True)
        except Exception as x:
            bad += 1
            print(f"FAIL {n}: {str(x)[:600]}", flush=True)
        close_all()
    sys.exit(bad > 0)
