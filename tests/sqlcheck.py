"""Compare registered queries with their SQL: columns, row count and values, order ignored.

Run as a script: ``python tests/sqlcheck.py [sf_dir] [query ...]``.
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return value
    return str(value)


def compare(con, frame, sql):
    """None when equal, else what differs first."""
    cursor = con.execute(sql)
    names = [item[0] for item in cursor.description]
    want = cursor.fetchall()
    got = frame.collect()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    order = sorted(names)
    left = sorted((tuple(plain(row[name]) for name in order) for row in got), key=repr)
    index = [names.index(name) for name in order]
    right = sorted((tuple(plain(row[i]) for i in index) for row in want), key=repr)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} rows differ {order}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return None if left else "EMPTY"


def plain_session():
    """A session with hardly any settings, as a stranger might bring it."""
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    return builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main():
    import __spark_entry__ as entry
    from netlens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = plain_session() if os.environ.get("PLAIN_SESSION") else local_session("sqlcheck")
    con = connect(sf_dir)
    queries, statements = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    failures = 0
    for name in wanted:
        start = time.time()
        try:
            if name in statements:
                problem = compare(con, queries[name](spark, sf_dir), statements[name])
            else:
                problem = None if queries[name](spark, sf_dir).count() else "EMPTY"
                name += " (rows only)"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - failures}/{len(wanted)} match; unmatched sql: {sorted(set(statements) - set(queries))}")


if __name__ == "__main__":
    main()
