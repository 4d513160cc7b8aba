"""Running totals and row numbers over a whole table, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotgrove.session import materialize


# Rows that one window may sort.
WINDOW_ROWS = 1_000_000


def running_total(df: DataFrame, keys: list[str], order: list[Column], amount: Column, out: str,
                  window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Add `out`, the sum of `amount` over the rows of the same `keys` up to and including this row.

    The rows are written first and counted. Few take one window. Many are range-partitioned by (keys, order);
    every range gets its own window, and the totals of the ranges before it are added. `order` must tell rows
    apart, so that a large group spans many ranges.
    """
    stored = materialize(df.withColumn("_amount", amount), "totals")
    upto = (Window.unboundedPreceding, Window.currentRow)
    if stored.count() <= window_rows:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        return stored.select(*df.columns, F.sum("_amount").over(whole).alias(out))
    ranged = materialize(
        stored.repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and range.
    offsets = (ranged.groupBy(*keys, "_range").agg(F.sum("_amount").alias("_sum"))
               .select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*upto)
    local = ranged.withColumn("_local", F.sum("_amount").over(inside))
    # Null-safe: rows without a key are a group like any other.
    named = offsets.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                           F.col("_range").alias("_of"), "_offset")
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return local.join(named, same).select(*df.columns, (F.col("_local") + F.col("_offset")).alias(out))


def row_numbers(df: DataFrame, order: list[Column], out: str, keys: list[str] | None = None,
                window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Number the rows from 1 in `order`, for the whole table or for each key."""
    return running_total(df, keys or [], order, F.lit(1).cast("bigint"), out, window_rows)


# Above this limit the engine no longer trims a ranked window before its shuffle.
_TRIMMED_WINDOW_LIMIT = 1000


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str,
                  spread: list[str], buckets: int = 256) -> DataFrame:
    """The first `limit` rows of every group, ranked from 1.

    Small limits are trimmed inside each task before the shuffle. For large ones each group is first cut
    within hash buckets of `spread`, so that a group with most of the rows is not sorted by one task.
    """
    if limit > _TRIMMED_WINDOW_LIMIT:
        bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
        inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
        df = (bucketed.withColumn("_rank", F.row_number().over(inner))
              .where(F.col("_rank") <= limit).drop("_rank", "_bucket"))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)
