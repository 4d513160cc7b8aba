"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

1. Rows are dealt to source blocks by a hash and counted. How many rows of each block go to each shard is drawn exactly
   as a uniform shuffle of all rows would give it (multivariate hypergeometric, conditional draws).
2. In a block the rows are put in random order; the first rows go to shard 0, the next to shard 1, and so on.
3. In a shard the rows are put in random order again, which gives the slots.

"Random" is a keyed hash of the row, so a task that runs again does the same. Only the narrow columns move; a shard is
ordered in many pieces, so no task holds a whole shard. The matrix has at most `MAX_BLOCKS` rows whatever the input.

Defined results: shard sizes differ by one at most, the first shards being the longer ones. NULL texts count as empty.
Rows with NULL ids and repeated rows are placed like any others (equal rows are interchangeable). An empty table gives
an empty result. Further columns are not read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotgrove.llm.common import read, text_or_empty
from shotgrove.session import materialize

# Rows of a source block, and of an ordered piece of a shard, that are aimed at.
BLOCK_ROWS = 20_000
MAX_BLOCKS = 4096


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` from an urn without replacement are good; exact for any size.

    Inversion outwards from the mode: the expected number of steps is some standard deviations.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - at_mode
    if left < 0:
        return mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left < 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode  # rounding left less than 1e-12 of the probability


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each block for each shard: block totals as given, shard totals one apart at most."""
    rng = random.Random(seed)
    total = sum(block_rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for rows in block_rows:
        left, others, line = rows, sum(room), []
        for s in range(shards):
            others -= room[s]
            line.append(hypergeometric(rng, room[s], others, left))
            left -= line[-1]
        room = [a - b for a, b in zip(room, line)]
        matrix.append(line)
    return matrix


def shuffle_into_shards(df: DataFrame, identity: list[Column], shards: int, seed: int = 0,
                        block_rows: int = BLOCK_ROWS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Add `shard` and `slot`. `identity` tells rows apart; `df` should be narrow."""
    names = df.columns
    table = df.withColumns({"_block_key": F.xxhash64(F.lit(seed), *identity),
                            "_order": F.xxhash64(F.lit(seed + 1), *identity),
                            "_again": F.xxhash64(F.lit(seed + 2), *identity)})
    stored = materialize(table, "rows")
    blocks = min(max_blocks, max(8, stored.count() // block_rows))
    stored = stored.withColumn("_block", F.pmod("_block_key", F.lit(blocks)).cast("int"))
    counts = [0] * blocks
    for row in stored.groupBy("_block").count().collect():  # one row per block
        counts[row["_block"]] = row["count"]
    matrix = communication_matrix(counts, shards, seed)
    # Upper ends of the shards' ranges in each block, as a list by block.
    ends = df.sparkSession.createDataFrame(
        [(b, [sum(line[:s + 1]) for s in range(shards)]) for b, line in enumerate(matrix)],
        "_block int, _ends array<bigint>")
    in_block = Window.partitionBy("_block").orderBy("_order", *identity)
    dealt = (stored.withColumn("_rank", F.row_number().over(in_block)).join(F.broadcast(ends), "_block")
             .withColumn("shard", F.size(F.filter("_ends", lambda end: end < F.col("_rank"))).cast("int")))
    # The second order is by (piece, hash): both are random, so the order is uniform.
    pieces = max(1, blocks // 2)
    piece_of = F.pmod(F.shiftrightunsigned("_again", 20), F.lit(pieces)).cast("int")
    dealt = materialize(dealt.select(*names, "_again", "shard", piece_of.alias("_piece")), "dealt")
    sizes = dealt.groupBy("shard", "_piece").count()  # shards x pieces rows
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    in_piece = Window.partitionBy("shard", "_piece").orderBy("_again", *identity)
    return (dealt.withColumn("_rank", F.row_number().over(in_piece))
            .join(F.broadcast(offsets), ["shard", "_piece"])
            .select(*names, "shard", (F.col("_offset") + F.col("_rank") - 1).alias("slot")))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    text = text_or_empty(documents)
    narrow = documents.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                              F.crc32(text).alias("text_crc32"))
    placed = shuffle_into_shards(narrow, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
