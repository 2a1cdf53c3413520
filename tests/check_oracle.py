"""Compare registered queries with their SQL twins: ``python tests/check_oracle.py [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from cairnflow.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def cell(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if value is not None and not isinstance(value, (int, str)):
        try:
            return round(float(value), 6) + 0.0
        except (TypeError, ValueError):
            return str(value)
    return value


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(cell(row[i]) for i in order) for row in rows]
    return sorted(table, key=repr)


def compare(spark, connection, sf_dir: str, name: str) -> str:
    """"" when both sides agree, else the first difference."""
    frame = queries()[name](spark, sf_dir)
    ours = normal(frame.columns, frame.collect())
    text = oracle_sql().get(name)
    if text is None:
        return "" if ours else "no rows"
    cursor = connection.execute(text)
    columns = [c[0] for c in cursor.description]
    theirs = normal(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for mine, other in zip(ours, theirs):
        same = all(
            math.isclose(a, b, abs_tol=2e-6) if isinstance(a, (int, float)) and isinstance(b, (int, float)) else a == b
            for a, b in zip(mine, other)
        )
        if not same:
            return f"{str(mine)[:300]} != {str(other)[:300]}"
    return ""


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    names = sys.argv[2:] or list(queries())
    spark, connection = local_session(8), connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - start:.1f}s {problem}", flush=True)


if __name__ == "__main__":
    main()
