"""Runs registered queries in Spark and their SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings parsed_refs catalog_works course_readings citations text_quality link_checks chapters toc_entries size_limits".split()


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    out = con.sql(sql)
    names = list(out.columns)
    return names, out.fetchall()


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return "" if v is None else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir: str, name: str) -> str:
    """'' where both give the same columns and rows, else what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    a = canonical(df.columns, [tuple(r) for r in df.collect()])
    names, rows = oracle_rows(sf_dir, entry.oracle_sql()[name])
    b = canonical(names, rows)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if a == b:
        return ""
    x, y = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; only in Spark: {sorted(x - y)[:2]}; only in SQL: {sorted(y - x)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    for name in sys.argv[2:] or sorted(entry.oracle_sql()):
        t = time.time()
        try:
            d = differences(spark, sys.argv[1], name)
        except Exception as e:  # noqa: BLE001
            d = "ERROR " + str(e)[:600]
        print(f"{name} {time.time() - t:.1f}s {'ok' if not d else d}"[:900], flush=True)
