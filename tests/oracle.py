"""Runs registered queries next to their SQL and compares all rows.

    python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def spark_rows(df):
    columns = sorted(df.columns)
    kinds = dict(df.dtypes)
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    return [(c, kinds[c]) for c in columns], rows


def sql_rows(con, text: str):
    cursor = con.execute(text)
    names = [c[0] for c in cursor.description]
    kinds = [str(c[1]) for c in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    return [(names[i], kinds[i]) for i in order], rows


SAME = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
        "int": "INTEGER"}


def compare(spark, con, folder: str, query) -> tuple[str, float, float]:
    from plumbline.plans.dataset import Dataset

    start = time.time()
    columns, rows = spark_rows(query.plan(Dataset(spark, folder)))
    spark_seconds = time.time() - start
    if query.sql is None:
        return f"rows-only ({len(rows)})", spark_seconds, 0.0
    start = time.time()
    other_columns, other_rows = sql_rows(con, query.sql)
    sql_seconds = time.time() - start
    if [c for c, _ in columns] != [c for c, _ in other_columns]:
        return f"COLUMNS {columns} {other_columns}", spark_seconds, sql_seconds
    if [SAME.get(k, k) for _, k in columns] != [k for _, k in other_columns]:
        return f"TYPES {columns} {other_columns}", spark_seconds, sql_seconds
    if rows != other_rows:
        only = [r for r in rows if r not in set(other_rows)][:3]
        missing = [r for r in other_rows if r not in set(rows)][:3]
        return (
            f"ROWS {len(rows)} vs {len(other_rows)}: {str(only)[:900]} / {str(missing)[:900]}",
            spark_seconds, sql_seconds,
        )
    return f"ok ({len(rows)})", spark_seconds, sql_seconds


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main() -> int:
    from plumbline.catalog import REGISTRY

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(folder)
    bad = 0
    for name, query in REGISTRY.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            verdict, a, b = compare(spark, con, folder, query)
        except Exception as error:  # noqa: BLE001
            verdict, a, b = f"ERROR {type(error).__name__}: {str(error)[:700]}", 0.0, 0.0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:32} {a:6.2f}s {b:6.2f}s {verdict}", flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
