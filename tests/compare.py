"""Run registered queries next to their SQL and compare rows exactly."""

from __future__ import annotations

import datetime
import math
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value) if abs(value) < 1 << 53 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def as_counter(rows, names) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, name, query, sql, folder) -> tuple[bool, str]:
    began = time.time()
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - began
    if sql is None:
        return True, f"{name:22s} rows-only {len(rows):7d}  {spent:6.2f}s"
    began = time.time()
    found = connect(folder).sql(sql)
    wanted = found.fetchall()
    other = time.time() - began
    if sorted(df.columns) != sorted(found.columns):
        return False, f"{name}: columns {sorted(df.columns)} vs {sorted(found.columns)}"
    mine, theirs = as_counter(rows, df.columns), as_counter(wanted, found.columns)
    if mine == theirs:
        return True, f"{name:22s} ok        {len(rows):7d}  {spent:6.2f}s  sql {other:6.2f}s"
    extra, missing = list((mine - theirs).elements()), list((theirs - mine).elements())
    return False, (
        f"{name}: {len(rows)} vs {len(wanted)} rows, {len(extra)} only here, {len(missing)} only in SQL\n"
        f"   here {str(extra[:2])[:700]}\n   sql  {str(missing[:2])[:700]}"
    )


def main() -> None:
    import sys

    import __spark_entry__ as entry
    from passagework.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in wanted or queries:
        try:
            ok, line = compare(spark, name, queries[name], sql.get(name), folder)
        except Exception as exc:
            ok, line = False, f"{name}: {type(exc).__name__} {str(exc)[:1500]}"
        bad += not ok
        print(("" if ok else "FAIL ") + line, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
