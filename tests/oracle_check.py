"""Run queries and their SQL side by side and compare all rows.

    python tests/oracle_check.py [sf_dir] [name ...]
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
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def kind(values) -> str:
    found = {type(v).__name__ for v in values if v is not None}
    return "/".join(sorted(found))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    left_at = [df.columns.index(c) for c in sorted(names)]
    right_at = [names.index(c) for c in sorted(names)]
    left = sorted((tuple(normal(r[i]) for i in left_at) for r in rows), key=repr)
    right = sorted((tuple(normal(r[i]) for i in right_at) for r in expected), key=repr)
    for i, c in enumerate(sorted(names)):
        kinds = kind(r[i] for r in left), kind(r[i] for r in right)
        if kinds[0] != kinds[1]:
            return f"column {c}: {kinds[0]} != {kinds[1]}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        a, b = bad[0]
        return f"{len(bad)} of {len(left)} rows differ, first: {str(a)[:600]} != {str(b)[:600]}"
    return None


def main() -> int:
    from tablewright.session import local_session
    import __spark_entry__ as entry_point

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    spark, con, failed = local_session("8"), connect(sf_dir), []
    for name in wanted:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        mark = "ok" if problem is None else "FAIL"
        note = "" if name in oracles else " (rows only)"
        print(f"{mark:4} {name}{note} {time.time() - started:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
