"""Run registered queries next to their SQL in DuckDB: python tests/check_sql.py [sf_dir] [query ...]"""

import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tables(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(frame, con, sql):
    """None if equal, else what differs; and the number of rows."""
    got_columns, got = frame.columns, frame.collect()
    got = rows(got_columns, got)
    if sql is None:
        return None, len(got)
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}", len(got)
    want = rows(want_columns, result.fetchall())
    if got == want:
        return None, len(got)
    in_got, in_want = set(got), set(want)
    extra, lacking = [r for r in got if r not in in_want][:3], [r for r in want if r not in in_got][:3]
    return f"{len(got)} rows != {len(want)}; only Spark {extra}; only SQL {lacking}", len(got)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = tables(sf_dir)
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem, n = compare(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql().get(name))
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name:32s} {kind:4s} {n:7d} rows {time.time() - start:6.2f} s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    sys.exit(bad > 0)
