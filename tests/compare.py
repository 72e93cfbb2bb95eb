"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paperloom.plans.catalogue import checking_sql, spark_queries
from paperloom.sources.views import BASE_TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.8g}"
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, name: str) -> str:
    started = time.time()
    df = spark_queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    sql = checking_sql().get(name)
    if sql is None:
        return f"rows {len(got)} ({spent:.1f}s)"
    started = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    want = rows_of(names, result.fetchall())
    note = f"{len(got)} rows, spark {spent:.1f}s, sql {time.time() - started:.1f}s"
    if sorted(names) != sorted(df.columns):
        return f"DIFFERENT columns {sorted(df.columns)} / {sorted(names)}"
    plain = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    kind_notes = [f"{c}: {t}/{kinds[c]}" for c, t in df.dtypes if plain.get(t) != kinds[c]]
    if got != want:
        got_set, want_set = set(got), set(want)
        missing = [tuple(c[:200] for c in r) for r in want if r not in got_set][:2]
        extra = [tuple(c[:200] for c in r) for r in got if r not in want_set][:2]
        return f"DIFFERENT rows {len(got)}/{len(want)}\n   missing {missing}\n   extra {extra}"
    return f"same, {note}" + (f" TYPES {kind_notes}" if kind_notes else "") + (" EMPTY" if not got else "")


if __name__ == "__main__":
    from paperloom.session import local_session

    folder = sys.argv[1]
    spark = local_session("8")
    con = connect(folder)
    for query in sys.argv[2:] or list(spark_queries()):
        try:
            print(f"{query}: {compare(spark, con, folder, query)}", flush=True)
        except Exception as e:
            print(f"{query}: FAILED {str(e)[:1500]}", flush=True)
