"""Run registered queries beside their SQL and report differences.

    python tools/compare.py [--sf DIR] [--task-rows N] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from blocktrace.catalog import QUERIES, SQL  # noqa: E402
from blocktrace.plans.layout import TASK_ROWS_CONF  # noqa: E402
from blocktrace.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value.is_integer() else value
    return value


def sortable(row):
    return tuple((v is None, str(type(v)), v) if not isinstance(v, (int, float)) or isinstance(v, bool)
                 else (False, "n", v) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=sortable)


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def difference(spark, connection, folder: str, name: str) -> str | None:
    """Text of the first difference, or None. Queries without SQL are only run."""
    result = QUERIES[name](spark, folder)
    got = rows_of(result.columns, [tuple(r) for r in result.collect()])
    if name not in SQL:
        return None if got else "no rows"
    cursor = connection.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(result.columns):
        return f"columns {sorted(result.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            wrong = sum(x != y for x, y in zip(got, want))
            return f"{wrong} of {len(got)} rows differ, first {a} != {b}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--task-rows", default=None)
    args = parser.parse_args()
    spark = local_session(8)
    if args.task_rows:
        spark.conf.set(TASK_ROWS_CONF, args.task_rows)
    connection = connect(args.sf)
    failed = 0
    for name in QUERIES:
        if args.names and not any(part in name for part in args.names):
            continue
        start = time.time()
        try:
            wrong = difference(spark, connection, args.sf, name)
        except Exception as error:  # noqa: BLE001 - reported per query
            wrong = f"{type(error).__name__}: {str(error)[:600]}"
        spark.catalog.clearCache()
        failed += wrong is not None
        kind = "sql" if name in SQL else "rows"
        print(f"{'ok  ' if wrong is None else 'FAIL'} {time.time() - start:6.1f}s {kind:4} {name} {wrong or ''}",
              flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
