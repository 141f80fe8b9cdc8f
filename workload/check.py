"""Run queries and their SQL side by side: python -m workload.check [sf_dir] [query ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from workload.oracle import ORACLE
from workload.queries import REGISTERED


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, _sorted([tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()])


def sql_rows(con: duckdb.DuckDBPyConnection, text: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(text)
    order = sorted((d[0], i) for i, d in enumerate(found.description))
    return [name for name, _ in order], _sorted([tuple(r[i] for _, i in order) for r in found.fetchall()])


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda row: tuple((v is not None, str(type(v)), v) for v in row))


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """'' where both sides agree in columns, types, rows and values."""
    names, rows = spark_rows(REGISTERED[name](spark, sf_dir))
    if name not in ORACLE:
        return "" if rows else "no rows"
    sql_names, expected = sql_rows(con, ORACLE[name])
    if names != sql_names:
        return f"columns {names} / {sql_names}"
    if len(rows) != len(expected):
        return f"rows {len(rows)} / {len(expected)}"
    for row, other in zip(rows, expected):
        if row != other or [type(v) for v in row] != [type(v) for v in other]:
            return f"{row} / {other}"
    return ""


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTERED)
    spark, con = session(), connect(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if name in ORACLE else "rows"
        print(f"{'ok  ' if not problem else 'FAIL'} {kind:4} {name:32} {time.time() - start:6.1f}s {problem}", flush=True)
        failed += [name] if problem else []
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
