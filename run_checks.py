"""Run the registered queries against their SQL on DuckDB.

    python run_checks.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks import CHECKS
from sigtrail.session import drop_stages


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    """Text that keeps the type apart: 1 and 1.0 differ, as do 0.1 and 0.1000001."""
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return repr(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[bool, str]:
    entry = CHECKS[name]
    begin = time.time()
    got = entry.run(spark, sf_dir)
    names, rows = normal(got.columns, [tuple(r) for r in got.collect()])
    took = time.time() - begin
    if entry.sql is None:
        return len(rows) > 0, f"{len(rows)} rows, no SQL, {took:.1f}s"
    begin = time.time()
    want = con.sql(entry.sql)
    want_names, want_rows = normal(want.columns, want.fetchall())
    sql_took = time.time() - begin
    if names != want_names:
        return False, f"columns {names} != {want_names}"
    if rows != want_rows:
        extra, missing = list(set(rows) - set(want_rows))[:2], list(set(want_rows) - set(rows))[:2]
        return False, f"{len(rows)} rows != {len(want_rows)}; only here {extra}; only SQL {missing}"
    return True, f"{len(rows)} rows, {took:.1f}s, SQL {sql_took:.1f}s"


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sigtrail-checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", os.environ.get("SIGTRAIL_SCRATCH") or tempfile.mkdtemp(prefix="sigtrail-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    failed = 0
    for name in args or CHECKS:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        drop_stages(spark)
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{failed} failed of {len(args or CHECKS)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
