"""Compares a query with its SQL on the same tables.

Also a command: `python tests/compare.py FOLDER [query ...]`.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def _rows(result: pa.Table) -> list[tuple]:
    result = result.select(sorted(result.column_names))
    rows = zip(*[c.to_pylist() for c in result.columns])

    def plain(value):
        return f"{value:.6g}" if isinstance(value, float) and not math.isnan(value) else repr(value)

    return sorted(tuple(plain(v) for v in row) for row in rows)


def _types(result: pa.Table) -> dict[str, str]:
    return {f.name: str(f.type) for f in sorted(result.schema, key=lambda f: f.name)}


def differences(spark, db, query, sql: str, folder: str) -> tuple[list[str], int]:
    df = query(spark, folder)
    problems = [f"plan holds {join}" for join in ("CartesianProduct", "NestedLoop")
                if join in df._jdf.queryExecution().executedPlan().toString()]
    got = df.toArrow()
    want = db.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {got.column_names} / {want.column_names}"], got.num_rows
    if _types(got) != _types(want):
        problems.append(f"types {_types(got)} / {_types(want)}")
    a, b = _rows(got), _rows(want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        problems.append(f"rows {len(a)} / {len(b)}; only here {len(only_a)} {str(only_a[:1])[:300]}; "
                        f"only there {len(only_b)} {str(only_b[:1])[:300]}")
    return problems, got.num_rows


def main() -> None:
    from shotgrove.plans.catalog import QUERIES, SQL
    from shotgrove.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    failed = 0
    for name in names or QUERIES:
        begun = time.time()
        try:
            if name in SQL:
                problems, n = differences(spark, db, QUERIES[name], SQL[name], folder)
            else:
                problems, n = [], QUERIES[name](spark, folder).toArrow().num_rows
        except Exception as error:  # noqa: BLE001
            problems, n = [f"{type(error).__name__}: {str(error)[:1500]}"], -1
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:24s} {n:7d} rows {time.time() - begun:6.2f}s "
              f"{'' if name in SQL else '(rows only)'} {'; '.join(problems)}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
