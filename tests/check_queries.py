"""Compare registered queries with their SQL: python tests/check_queries.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
            return "~"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(t) for c, t in df.dtypes.items()}


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    from __spark_entry__ import oracle_sql, queries

    start = time.time()
    got = queries()[name](spark, folder).toPandas()
    took = time.time() - start
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    start = time.time()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    note = f"{len(got)} rows, {took:.1f}s, sql {time.time() - start:.1f}s"
    differ = {c: (k, kinds(want)[c]) for c, k in kinds(got).items() if k != kinds(want)[c]}
    if differ:
        note += f" TYPES {differ}"
    if len(got) == 0:
        note += " EMPTY"
    if a != b:
        first = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return False, f"{note}; {len(a)} / {len(b)} rows, first difference {str(first)[:500]}"
    return True, note


if __name__ == "__main__":
    from labspark.session import local_session

    from __spark_entry__ import queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con, bad = local_session(8), connect(folder), []
    for name in names:
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001  report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        bad += [] if ok else [name]
    print(len(names) - len(bad), "of", len(names), "ok; failed:", bad)
