"""The registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


# Tables whose rows cost work in each task.
_SPREAD = ("documents", "conversations", "embeddings", "lineitem", "orders")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(scan) if name in _SPREAD else scan


def rounded(value: Column | str) -> Column:
    """Six digits, and no negative zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)


def joined(items: Column | str) -> Column:
    """A list as one string, for results that are compared by value."""
    return F.array_join(F.col(items).cast("array<string>") if isinstance(items, str) else items, " ")
