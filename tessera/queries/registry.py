"""Where queries register themselves with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its name; ``sql``: the equivalent for DuckDB, if there is one."""

    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the directory ``d``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql(name: str, text: str, oracle: str | None = "") -> None:
    """Register a query in SQL; ``{table}`` stands for a table. ``oracle``: DuckDB's SQL if it differs, None if there is none."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, d, t) for t in names})

    run.__name__ = name
    QUERIES[name] = run
    if oracle is not None:
        SQL[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or text)
