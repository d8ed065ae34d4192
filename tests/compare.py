"""Runs queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import os
import sys
import time
import traceback
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str | None) -> str:
    """'' if both give the same rows, else what differs. Without SQL only the query runs."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return ""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, found.fetchall())
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; only here {[x[:300] for x in set(a) - set(b)][:2]}; only there {[x[:300] for x in set(b) - set(a)][:2]}"


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, *names = sys.argv[1:]
    con, oracles, bad = connection(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            why = compare(spark, con, sf_dir, query, oracles.get(name))
        except Exception:
            why = traceback.format_exc()[-700:]
        bad += bool(why)
        print(f"{name}: {'FAIL ' + why if why else 'ok' if name in oracles else 'ran'} {time.time() - t:.1f} s", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
