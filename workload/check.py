"""Run queries next to their SQL: ``python -m workload.check [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession

from workload.oracles import ORACLES
from workload.queries import QUERIES

if TYPE_CHECKING:
    import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
    pages benchmark labels conversations""".split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    # Sessions are made where this is not installed, too.
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (1, repr(float(value) + 0.0))
    return (1, str(value))


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty when equal, else what differs."""
    ours = QUERIES[name](spark, sf_dir)
    mine = rows_of(ours.columns, ours.collect())
    if name not in ORACLES:
        return "" if mine else "no rows"
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(ours.columns):
        return f"columns {sorted(ours.columns)} and {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} and {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), database(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in wanted:
        start = time.perf_counter()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        kind = "sql " if name in ORACLES else "rows"
        took = time.perf_counter() - start
        print(f"{'FAIL' if problem else 'ok  '} {kind} {took:6.2f}s {name} {problem}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} equal")


if __name__ == "__main__":
    main()
