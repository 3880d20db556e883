"""Run registered queries and their oracle SQL side by side.

    python tests/parity.py [name ...]      # all queries without names
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    took = time.time() - started
    if sql is None:
        return bool(rows), f"{len(rows)} rows, no oracle, {took:.1f}s"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    got, want = rows_of(df.columns, rows), rows_of(columns, expected)
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        return False, f"{len(rows)} vs {len(expected)} rows\n   spark {extra}\n   sql   {missing}"
    return True, f"{len(rows)} rows, {took:.1f}s"


def session(master: str = "local[8]"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(names: list[str], sf_dir: str) -> int:
    import __spark_entry__ as entry

    spark, con = session(), duck(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as problem:
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    sys.exit(main(sys.argv[1:], folder) > 0)
