"""Compare registered queries with their SQL on DuckDB. Also a command line tool:

python -m tests.oracle [folder] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return float(value)
    return value


def _rows(rows):
    cleaned = [tuple(_plain(v) for v in row) for row in rows]
    return sorted(cleaned, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def compare(frame, connection, sql: str) -> str | None:
    """None if equal, else what differs."""
    ours_columns = sorted(frame.columns)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs_raw = result.fetchall()
    if ours_columns != sorted(names):
        return f"columns {sorted(set(ours_columns) ^ set(names))}"
    order = [names.index(c) for c in ours_columns]
    theirs = _rows([[row[i] for i in order] for row in theirs_raw])
    ours = _rows([list(row) for row in frame.select(*[f"`{c}`" for c in ours_columns]).collect()])
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ, first {ours_columns}: {wrong[0]}"
    kinds = [(c, a, b) for c, a, b in zip(ours_columns, ours[0], theirs[0], strict=True)
             if a is not None and b is not None and type(a) is not type(b)] if ours else []
    return f"types {kinds}" if kinds else None


def main(arguments: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    parts = arguments[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, queries, sql, bad = connect(folder), entry.queries(), entry.oracle_sql(), 0
    for name, run in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            problem = compare(frame, connection, sql[name]) if name in sql else f"no SQL, {len(frame.collect())} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        good = problem is None or problem.startswith("no SQL")
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
