"""Run the Spark queries beside their DuckDB twins: ``python -m checks.compare [sf_dir] [key ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from decimal import Decimal

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from checks.views import TABLES
from ripplemark import build_session, drop_stages


def normal(value: object) -> object:
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(keyed, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(df, con, key: str) -> str:
    """'' when the frame equals its twin, else what differs."""
    ours = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if key not in ORACLE:
        return "" if ours else "no rows"
    cur = con.execute(ORACLE[key])
    names = [d[0] for d in cur.description]
    theirs = sorted_rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        return f"rows {len(ours)} / {len(theirs)}; only ours {sorted(a, key=str)[:3]}; only theirs {sorted(b, key=str)[:3]}"
    return "" if ours else "both empty"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-"),
    }
    spark = build_session(master="local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            problem = compare(QUERIES[key](spark, sf_dir), con, key)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {key} {time.time() - start:.1f}s {problem}", flush=True)
    drop_stages(spark)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
