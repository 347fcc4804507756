"""Run registered queries on Spark and DuckDB and compare them by value.

Usage: python tests/oracle.py [folder] [name-regex]
"""

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r)
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in data), key=key)


def compare(spark, con, name, folder, queries, oracle):
    df = queries[name](spark, folder)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracle:
        return len(a[1]), None
    cur = con.execute(oracle[name])
    b = rows([c[0] for c in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return len(a[1]), f"columns {a[0]} vs {b[0]}"
    if a[1] != b[1]:
        diff = [(x, y) for x, y in zip(a[1], b[1]) if x != y][:2]
        return len(a[1]), f"{len(a[1])} vs {len(b[1])} rows; first differences {a[0]} {diff}"
    return len(a[1]), None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pattern = sys.argv[2] if len(sys.argv) > 2 else "."
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in q:
        if not re.search(pattern, name):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, name, folder, q, o)
        except Exception as x:  # report and go on with the next query
            n, err = -1, f"{type(x).__name__}: {str(x)[:600]}"
        bad += err is not None
        mark = "FAIL" if err else ("ok" if name in o else "rows")
        print(f"{mark:5}{name:28}{n:8}{time.time() - t:8.2f}s {err or ''}", flush=True)
    print("failures:", bad)
