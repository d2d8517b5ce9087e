"""Runs registered queries against their SQL on DuckDB.

    python tests/oracle.py [query ...]      (SF_DIR selects the tables)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablegauge.queries import all_queries  # noqa: E402
from tablegauge.queries.support import TABLES  # noqa: E402

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("null",) if math.isnan(value) else ("float", repr(value))
    if isinstance(value, int):
        return ("int", repr(value))
    if hasattr(value, "as_tuple"):
        return ("decimal", str(value))
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def difference(query, spark, connection, sf_dir: str) -> str | None:
    """None when both engines give the same rows under the same column names."""
    frame = query.run(spark, sf_dir)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(query.sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns differ: {sorted(frame.columns)} / {sorted(names)}"
    query.n_rows = len(ours)
    if ours == theirs:
        return None
    only_ours = sorted(set(ours) - set(theirs))[:3]
    only_theirs = sorted(set(theirs) - set(ours))[:3]
    return f"{len(ours)} / {len(theirs)} rows\n   spark  {only_ours}\n   duckdb {only_theirs}"


def main() -> int:
    from tests.conftest import make_session

    spark = make_session()
    connection = connect(SF_DIR)
    wanted = sys.argv[1:]
    failed = 0
    for name, query in all_queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            problem = difference(query, spark, connection, SF_DIR) if query.sql else None
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        n = "" if problem is None else f"\n  {problem}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {getattr(query, 'n_rows', '?')} rows{n}", flush=True)
        failed += problem is not None
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
