"""Run queries on Spark and on the other engine and compare rows and columns.

    python -m checks.compare [sf_dir] [name …]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.registry import QUERIES
from govlens.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(v)) for v in row),
    )


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    actual = rows_of(df.columns, df.collect())
    if name not in ORACLE:
        return f"rows only: {len(actual)}"
    cursor = con.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} <> {sorted(columns)}"
    if actual != expected:
        differ = [(a, e) for a, e in zip(actual, expected) if a != e]
        return f"ROWS {len(actual)} <> {len(expected)}; first: {differ[:1]}"
    return f"ok {len(actual)}"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con, failed = local_session(), database(sf_dir), []
    for name in args or QUERIES:
        begin = time.time()
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as error:
            result = f"ERROR {str(error)[:700]}"
        if not result.startswith(("ok", "rows only")):
            failed.append(name)
        print(f"{name:32} {time.time() - begin:6.2f}s  {result}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
