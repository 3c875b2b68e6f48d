"""Run registered queries in Spark and their check SQL in DuckDB, and compare."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, folder: str, name: str, db=None) -> str | None:
    """None when both agree, else what differs."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    sql = e.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cur = (db or connect(folder)).execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not want and not got:
        return "no rows on either side"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a == b:
        kinds = {d[0]: str(d[1]) for d in cur.description}
        same = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}
        off = [
            (f.name, f.dataType.simpleString(), kinds[f.name])
            for f in df.schema
            if same.get(kinds[f.name], f.dataType.simpleString()) != f.dataType.simpleString()
        ]
        return f"types {off}" if off else None
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return f"rows {len(a)} vs {len(b)}\n   spark only {str(only_a)[:900]}\n   sql only   {str(only_b)[:900]}"


if __name__ == "__main__":
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    db = connect(folder)
    wanted = sys.argv[1:]
    for name in e.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, folder, name, db)
        except Exception as x:
            problem = f"{type(x).__name__}: {str(x)[:1500]}"
        tag = "ok  " if problem is None else "BAD "
        if problem is None and name not in e.oracle_sql():
            tag = "rows"
        print(tag, name, f"{time.time() - start:.1f}s", problem or "", flush=True)
