"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from netlens.plans import host_queries, host_sql, reference_sql, request_queries, stream_queries
from netlens.sources.jsonl import repeated_keys

Query = Callable[[SparkSession, str], DataFrame]


#: Generated methods above 8000 bytecodes are never compiled by the JVM; Spark splits wide projections into small ones instead.
COMPILED = ("spark.sql.codegen.hugeMethodLimit", "8000")


def _compiled(query: Query) -> Query:
    """The query in a session whose generated methods stay small enough to be compiled; a smaller limit is left as it is."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        name, limit = COMPILED
        if int(spark.conf.get(name)) > int(limit):
            spark.conf.set(name, limit)
        with repeated_keys(spark):  # a self-join makes parsing expressions anew
            return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {**request_queries.QUERIES, **host_queries.QUERIES, **stream_queries.QUERIES}
    return {name: _compiled(query) for name, query in found.items()}


def statements() -> dict[str, str]:
    found = {**reference_sql.request_statements(), **host_sql.host_statements(), **stream_queries.STATEMENTS}
    return {name: by_binary_value(sql) for name, sql in found.items()}


def by_binary_value(sql: str) -> str:
    """``round_even(x, 1 or 2)`` of a statement, by the exact binary value of x as the format function knows it; never -0.0."""
    start, mark = 0, "round_even("
    while (start := sql.find(mark, start)) >= 0:
        depth, at, comma = 1, start + len(mark), 0
        while depth:
            char = sql[at]
            depth += (char == "(") - (char == ")")
            comma = at if char == "," and depth == 1 else comma
            at += 1
        value, digits = sql[start + len(mark) : comma], sql[comma + 1 : at - 1].strip()
        if digits in ("1", "2"):
            sql = f"{sql[:start]}(CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE) + 0.0){sql[at:]}"
        else:
            start = at
    return sql
