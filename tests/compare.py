"""Runs registered queries against their oracle SQL: `python tests/compare.py [sf] [name ...]`."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads=4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.date().isoformat() if value.time() == datetime.time(0) else value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        extra = [x for x in got if x not in set(want)][:2]
        missing = [x for x in want if x not in set(got)][:2]
        return f"rows {len(got)} vs {len(want)}\n   spark only: {extra}\n   oracle only: {missing}"
    return None if got else "EMPTY on both sides"


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    names = [q for q in queries if any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, queries[name], oracle.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        took = time.time() - start
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {took:.1f}s {problem or ('' if name in oracle else '(no oracle)')}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
