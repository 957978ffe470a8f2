"""Compare registered queries with their SQL: python tests/check_queries.py [--hot=N] [sf_dir] [names ...]

--hot=N treats keys with more than N rows as hot, so that small tables take the salted joins.
"""

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from hashloom.operators import skew  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hashloom-check")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return str(value) if hasattr(value, "as_tuple") else value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    listed = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(listed, key=lambda row: tuple((v is not None, str(v)) for v in row))


def compare(spark, connection, sf_dir, name):
    frame = entry_module.queries()[name](spark, sf_dir)
    got = normal(frame.columns, [tuple(row) for row in frame.collect()])
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return f"no SQL, {len(got[1])} rows"
    answer = connection.execute(sql)
    expected = normal([d[0] for d in answer.description], answer.fetchall())
    if got[0] != expected[0]:
        return f"COLUMNS {got[0]} != {expected[0]}"
    if len(got[1]) != len(expected[1]):
        return f"ROWS {len(got[1])} != {len(expected[1])}"
    wrong = [(a, b) for a, b in zip(got[1], expected[1]) if a != b]
    if wrong:
        return f"VALUES {len(wrong)} differ, first {wrong[0]}"
    return None if got[1] else "EMPTY"


def main():
    arguments = [a for a in sys.argv[1:] if not a.startswith("--hot=")]
    for option in [a for a in sys.argv[1:] if a.startswith("--hot=")]:
        skew.HOT_ROWS = int(option.partition("=")[2])
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(entry_module.queries())
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} with problems")


if __name__ == "__main__":
    main()
