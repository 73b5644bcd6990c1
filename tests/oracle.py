"""Compare every registered Spark query with its DuckDB oracle on one scale factor.

Usage: ``python tests/oracle.py [sf_dir] [name ...]``.  Prints one line per query
and exits non-zero on any mismatch.  Also used by ``tests/test_oracle.py``.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, f"{round(v, 6):.6f}")
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return (1, f"{float(v):.6f}")
    if isinstance(v, dt.datetime):
        return (2, v.replace(tzinfo=None).isoformat())
    return (3, str(v))


def canon(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duckdb={d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duckdb={len(d_rows)}"
    a, b = canon(s_cols, s_rows), canon(d_cols, d_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ, e.g. {diff}"
    return True, f"{len(s_rows)} rows, spark {t1 - t0:.2f}s"


def main(argv: list[str]) -> int:
    import __spark_entry__ as E
    from urbanframe.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in oracle:
            print(f"SKIP {name}: no oracle")
            continue
        try:
            ok, msg = compare(spark, con, name, fn, oracle[name], sf_dir)
        except Exception as exc:  # report and continue with the next query
            ok, msg = False, f"error {type(exc).__name__}: {str(exc)[:300]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg}", flush=True)
    print(f"{len(qs) - bad}/{len(qs)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
