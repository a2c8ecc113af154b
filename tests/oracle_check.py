"""Compare registered queries with their SQL on one scale factor: ``python tests/oracle_check.py [sf_dir] [names...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from eoframe.sources.adapters import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~" if v != v else (repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v))
    if hasattr(v, "as_tuple"):
        return _cell(float(v))
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    left_cols = spark_df.columns
    left = rows_of(left_cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    right_cols = [d[0] for d in cur.description]
    right = rows_of(right_cols, cur.fetchall())
    if sorted(left_cols) != sorted(right_cols):
        return f"columns {sorted(left_cols)} != {sorted(right_cols)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from eoframe.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con, failed = connect(sf_dir), 0
    for name, build in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df, sql = build(spark, sf_dir), oracle_sql().get(name)
            issue = compare(df, con, sql) if sql else f"rows only: {df.count()}"
            bad = bool(sql and issue)
        except Exception as e:  # noqa: BLE001
            issue, bad = f"ERROR {str(e)[:400]}", True
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - started:.1f}s {issue or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
