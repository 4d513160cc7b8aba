"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

# Rows of one id each that a join may broadcast (16 bytes a row in the hash table at least); more are shuffled.
BROADCAST_ROWS = 2_000_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hinted(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`stored`, a written table of few short columns, with a broadcast hint where its row count allows one."""
    return F.broadcast(stored) if stored.count() <= rows else stored


def free_name(df: DataFrame, stem: str) -> str:
    """`stem`, made longer until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id", rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of `df` whose key is not in the one column of `ids`; rows without a key stay."""
    name = free_name(df, "_gone_id")
    return df.join(hinted(ids.toDF(name), rows), df[key] == F.col(name), "left_anti")


def only_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id", rows: int = BROADCAST_ROWS) -> DataFrame:
    name = free_name(df, "_kept_id")
    return df.join(hinted(ids.toDF(name), rows), df[key] == F.col(name), "left_semi")


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo `divisor`; 0 for a missing key."""
    return F.coalesce(F.crc32(key.cast("string")) % divisor, F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
