"""Runs registered queries next to their SQL on the same tables.

    python tests/oracle_check.py [--sf /root/testdata/sf0.01] [--times] [prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from quillspark.session import build_session  # noqa: E402
from quillspark.sources.documents import TABLES  # noqa: E402


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def duck(path: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def compare(spark, con, path: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, path)
    got_columns, got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return bool(got), f"{sum(got.values())} rows, no SQL, {took:.1f}s"
    start = time.time()
    result = con.execute(sql)
    want_columns, want = rows([d[0] for d in result.description], result.fetchall())
    base = time.time() - start
    note = f"{sum(got.values())} rows, {took:.1f}s (sql {base:.1f}s)"
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return False, (f"{note}; {sum((got - want).values())} extra, {sum((want - got).values())} missing of "
                       f"{sum(want.values())}\n   got  {str(extra)[:900]}\n   want {str(missing)[:900]}")
    types = [f.dataType.simpleString() for f in df.schema]
    return True, note + ("" if sum(got.values()) else " EMPTY") + f" {types}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("prefix", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark, con = build_session("local[8]", 8, **{"spark.driver.memory": "20g", "spark.ui.enabled": "false",
                                                 "spark.ui.showConsoleProgress": "false"}), duck(args.sf)
    queries, sqls, bad = entry.queries(), entry.oracle_sql(), []
    for name in sqls:
        if name not in queries:
            bad.append(name)
            print("ORPHAN SQL", name)
    for name, query in queries.items():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        try:
            ok, note = compare(spark, con, args.sf, name, query, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
